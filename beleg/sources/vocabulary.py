"""The glossary vocabulary as small tables.

A vocabulary is one JSON document. Its tables are joined, not collected; they are glossary
sized, so Spark broadcasts them under its own size threshold, and joins them by shuffle
should one ever outgrow it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    schema_version string, content_hash string, term_iri_base string, vocab_iri_base string,
    normalization struct<stop_suffixes: array<string>>,
    terms map<string, struct<term: string, type: string, subdomain: string,
        labels: array<struct<text: string, lang: string, role: string, generic: boolean>>>>,
    alias_index map<string, string>,
    contested_aliases map<string, struct<senses: array<string>>>,
    generic_keys array<string>,
    predicates map<string, struct<inverse: string, symmetric: boolean, definition: string, maps_from: array<string>>>,
    predicate_map map<string, string>
"""


@dataclass(frozen=True)
class Vocabulary:
    """Tables of one vocabulary version."""

    meta: DataFrame           # schema_version, content_hash, term_iri_base, vocab_iri_base, suffix_pattern
    terms: DataFrame          # slug, term, type, subdomain
    keys: DataFrame           # key, slug, type, generic, senses: one row per alias or contested key
    predicate_map: DataFrame  # raw, canonical
    predicates: DataFrame     # canonical, inverse, symmetric, definition


def vocabulary_tables(raw: DataFrame) -> Vocabulary:
    """Tables of a one-row DataFrame with the vocabulary's schema."""
    meta = raw.select(
        "schema_version", "content_hash", "term_iri_base", "vocab_iri_base",
        # What the longest stop suffix of a key matches; a key is never a suffix alone.
        F.concat(F.lit("(?<=.)(?:"), F.array_join(F.transform(
            "normalization.stop_suffixes", lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|"), F.lit(r")\z")).alias("suffix_pattern"),
    )
    terms = raw.select(F.explode("terms").alias("slug", "t")).select("slug", "t.term", "t.type", "t.subdomain")
    alias = raw.select(F.explode("alias_index").alias("key", "slug"))
    contested = raw.select(F.explode("contested_aliases").alias("key", "c")).select("key", "c.senses")
    generic = raw.select(F.explode("generic_keys").alias("key")).distinct().withColumn("generic", F.lit(True))
    keys = (
        alias.join(terms.select("slug", "type"), "slug", "left")
        .join(contested, "key", "full_outer")
        .join(generic, "key", "left")
        .select("key", "slug", "type", F.coalesce("generic", F.lit(False)).alias("generic"), "senses")
    )
    predicate_map = raw.select(F.explode("predicate_map").alias("raw", "canonical")).select(
        F.lower("raw").alias("raw"), "canonical"
    )
    predicates = raw.select(F.explode("predicates").alias("canonical", "p")).select("canonical", "p.inverse", "p.symmetric", "p.definition")
    return Vocabulary(meta, terms, keys, predicate_map, predicates)


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return vocabulary_tables(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def vocabulary_from_json(spark: SparkSession, text: str) -> Vocabulary:
    """The same from JSON text in hand."""
    row = spark.createDataFrame([(text,)], "value string")
    return vocabulary_tables(row.select(F.from_json("value", SCHEMA).alias("v")).select("v.*"))
