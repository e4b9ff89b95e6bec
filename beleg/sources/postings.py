"""A stored inverted index: words by group of words, passages by block, scored where they lie.

The postings of a word lie in the folder of its group, so only folders of asked words are read; inside, files are sorted by
word and carry a Bloom filter on it. The table is bucketed by block of passages: all words of a passage come to the same task,
so scores are summed, and a question's best passages picked, before anything is shuffled. A word's weights in a block are
computed once, however many questions ask for it; a task adds them up in arrays, one question after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beleg.functions.markers import RETRIEVAL_BREADTH
from beleg.functions.text import tokens
from beleg.operators.retrieval import UNITS, bm25_units, query_terms

WORD_GROUPS = 32
WORDS_PER_BLOCK = 20_000_000  # about: a block is what one task scores
TERMS_AT_A_TIME = 20_000  # words of questions that are sent to all tasks
PUSHED_WORDS = 100  # up to so many words are looked up in the files' statistics and Bloom filters


class Postings(NamedTuple):
    """postings(token, passage_ids, tfs, lengths, block, word_group), words(token, df, word_group), and the corpus in numbers."""

    postings: DataFrame
    words: DataFrame
    n: int
    mean: float | None
    groups: int
    blocks: int


def _group(token: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(groups)).cast("int")


def _block_numbers(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each bucket that Spark's bucketing puts there, so that blocks and buckets are the same."""
    tried, found = 16 * blocks, {}
    while len(found) < blocks:
        numbers = spark.range(tried).select(F.col("id").cast("int").alias("v"))
        found = {r["b"]: r["v"] for r in numbers.groupBy(F.pmod(F.hash("v"), F.lit(blocks)).alias("b")).agg(F.min("v").alias("v")).collect()}
        tried *= 4
    return [found[b] for b in range(blocks)]


def _table(spark: SparkSession, path: str, schema: T.StructType, blocks: int) -> DataFrame:
    """The bucketed table at a path, under a name of this session's own."""
    name = f"postings_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (word_group) CLUSTERED BY (block) SORTED BY (token) INTO {blocks} BUCKETS LOCATION '{path}/postings'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def write_postings(passages: DataFrame, path: str, text: str = "text", groups: int = WORD_GROUPS, blocks: int | None = None) -> Postings:
    """Index a corpus once; ``read_postings`` opens it again. The meta table is written last: an index without it is none."""
    spark = passages.sparkSession
    # An inner explode would have its input tokenised again in an inferred "not empty" filter.
    worded = passages.select("passage_id", tokens(F.col(text)).alias("_tokens")).select("passage_id", F.size("_tokens").alias("length"), F.explode_outer("_tokens").alias("token"))
    counted = worded.groupBy("token", "passage_id", "length").agg(F.count("*").alias("tf"))
    counted.filter(F.col("token").isNotNull()).write.parquet(f"{path}/counted")
    stored = spark.read.schema(counted.schema).parquet(f"{path}/counted")
    words = stored.agg(F.sum("tf")).first()[0] or 0
    corpus = passages.agg(F.count("*").alias("n"), F.count(F.col(text)).alias("texts")).first()
    mean = words / corpus["texts"] if corpus["texts"] else None
    blocks = blocks or max(1, -(-words // WORDS_PER_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = F.array(*map(F.lit, _block_numbers(spark, blocks)))
    placed = stored.withColumn("block", F.get(numbers, F.pmod(F.xxhash64("passage_id"), F.lit(blocks)).cast("int")))
    placed = placed.repartition(blocks, "block").withColumn("word_group", _group(F.col("token"), groups))
    # Block is the partitioning already: neither the aggregate nor the bucketed write shuffles again.
    rows = placed.groupBy("block", "word_group", "token").agg(F.collect_list(F.struct("passage_id", "tf", "length")).alias("postings"))
    lists = (F.col(f"postings.{c}").alias(n) for c, n in (("passage_id", "passage_ids"), ("tf", "tfs"), ("length", "lengths")))
    rows = rows.select("token", *lists, "block", "word_group").sortWithinPartitions("word_group", "token")
    name = f"postings_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", f"{path}/postings").option("parquet.bloom.filter.enabled#token", "true").partitionBy("word_group").bucketBy(blocks, "block").sortBy("token").saveAsTable(name)
    frequencies = spark.table(name).groupBy("word_group", "token").agg(F.sum(F.size("tfs")).cast("bigint").alias("df"))
    frequencies.repartition("word_group").sortWithinPartitions("token").write.partitionBy("word_group").parquet(f"{path}/words")
    spark.sql(f"DROP TABLE {name}")
    id_type = passages.schema["passage_id"].dataType.simpleString()
    spark.createDataFrame([(corpus["n"], mean, groups, blocks, id_type)], "n long, mean double, groups int, blocks int, id_type string").coalesce(1).write.parquet(f"{path}/meta")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    meta = spark.read.parquet(f"{path}/meta").first()
    schema = T._parse_datatype_string(f"token string, passage_ids array<{meta['id_type']}>, tfs array<bigint>, lengths array<int>, block int, word_group int")
    words = spark.read.schema("token string, df bigint, word_group int").parquet(f"{path}/words")
    return Postings(_table(spark, path, schema, meta["blocks"]), words, meta["n"], meta["mean"], meta["groups"], meta["blocks"])


def _best_of_block(questions: list[tuple[object, list[str]]], breadth: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """The best passages of one block for each question; ties go to the least passage_id."""

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = [c for c in (table.column("passage_ids").chunks or [])]
        flat = pa.concat_arrays([c.flatten() for c in ids])
        units = np.concatenate([c.flatten().to_numpy() for c in table.column("units").chunks])
        passages, places = np.unique(flat.to_numpy(zero_copy_only=False), return_inverse=True)
        ends = np.cumsum([len(x) for c in ids for x in c])
        spans = {token: (end - n, end) for token, end, n in zip(table.column("token").to_pylist(), ends, np.diff(ends, prepend=0))}
        score, hit = np.zeros(len(passages), dtype=np.int64), np.zeros(len(passages), dtype=bool)
        out: list[tuple[list, np.ndarray, np.ndarray]] = []
        for query_id, words in questions:
            parts = [spans[w] for w in words if w in spans]
            if not parts:
                continue
            for a, b in parts:  # a passage is there once for a word
                score[places[a:b]] += units[a:b]
                hit[places[a:b]] = True
            found = np.flatnonzero(hit)
            if len(found) > breadth:
                least = np.partition(score[found], -breadth)[-breadth]
                found = found[score[found] >= least]
            found = found[np.lexsort((found, -score[found]))][:breadth]
            out.append(([query_id] * len(found), passages[found], score[found] / UNITS))
            score[:], hit[:] = 0, False
        columns = ([x for o in out for x in o[0]], np.concatenate([o[1] for o in out]) if out else [], np.concatenate([o[2] for o in out]) if out else [])
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return best


def retrieve_indexed(queries: DataFrame, index: Postings, breadth: int = RETRIEVAL_BREADTH, terms_at_a_time: int = TERMS_AT_A_TIME) -> DataFrame:
    """Top ``breadth`` passages per query by BM25, as ``retrieve`` gives them: (query_id, passage_id, score, rank).

    Questions go to the postings in batches of about ``terms_at_a_time`` words, so what is sent to a task is bounded however many
    there are. A task keeps its own ``breadth`` best passages of each question; these alone are shuffled.
    """
    terms = query_terms(queries)
    batches = max(1, -(-terms.count() // terms_at_a_time))
    ids = T.StructType([queries.schema["query_id"], T.StructField("passage_id", index.postings.schema["passage_ids"].dataType.elementType)]).add("score", "double")
    found = None
    for batch in range(batches):
        some = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == batch).groupBy("query_id").agg(F.collect_list("token").alias("words"))
        questions = [(r["query_id"], r["words"]) for r in some.collect()]  # about terms_at_a_time words
        asked = sorted({w for _, words in questions for w in words})
        tokens_of = queries.sparkSession.createDataFrame([(w,) for w in asked], "token string")
        groups = sorted({r["g"] for r in tokens_of.select(_group(F.col("token"), index.groups).alias("g")).distinct().collect()})
        wanted = F.col("word_group").isin(groups)
        if len(asked) <= PUSHED_WORDS:  # more are left to the join: the reader would test every value of a long list
            wanted &= F.col("token").isin(asked)
        words = index.words.filter(wanted).join(F.broadcast(tokens_of), "token").select("token", "df")
        units = F.zip_with("tfs", "lengths", lambda tf, length: bm25_units(tf, length, F.col("df"), F.lit(index.n), F.lit(index.mean)))
        near = index.postings.filter(wanted).join(F.broadcast(words), "token").select("block", "token", "passage_ids", units.alias("units"))
        best = near.groupBy("block").applyInArrow(_best_of_block(questions, breadth, to_arrow_schema(ids)), ids)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("passage_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= breadth)
