"""From documents to a training mix: each stage works on what the one before kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.llm import decontaminate, language, lines, mix, simhash
from beleg.llm.tables import cut_lineage, read_table, spare_name
from beleg.session import configure


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, whether or not there are rows to learn from. Nothing is read from lang but what the model learns from."""
    configure(spark)
    lang, score = spare_name(docs, "lang_pred"), spare_name(docs, "lang_score")
    model = language.train(docs)
    known = language.predict(docs, model if model.languages else language.any_language(), lang, score)
    return known.filter((F.col(lang) != language.UNKNOWN) | (F.col(score) > 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents that lose all their lines go."""
    return with_n_chars(lines.dedupe_lines(docs))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, with their slots."""
    return mix.mix(docs)


def with_n_chars(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return docs.select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


STAGES = [
    ("language", identify_language),
    ("lines", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("benchmark", remove_benchmark),
    ("mix", mix_sources),
]

# No SQL can express MinHash bands, a fitted classifier or an earliest-deadline-first schedule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
