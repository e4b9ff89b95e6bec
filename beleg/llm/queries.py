"""Registered queries of the operators, at production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from beleg.llm import conversations, decontaminate, language, licenses, lines, merkle, mix, oracles, ordermin, packing, personal, simhash, sitestyle, urls
from beleg.llm.tables import read_table
from beleg.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.judge(read_table(spark, sf_dir, "documents"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.judge(read_table(spark, sf_dir, "documents"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(read_table(spark, sf_dir, "documents"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judge(read_table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.judge(read_table(spark, sf_dir, "pages"))


@query
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.judge(read_table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (
  SELECT a.doc_id, a.i, a.n, v.item_id FROM spots AS a JOIN windows AS v ON a.win = v.win AND a.n = v.n
), positions AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS bigint) AS n_words, CAST(coalesce(p.n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(f.n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN positions AS p ON p.doc_id = d.doc_id LEFT JOIN found AS f ON f.doc_id = d.doc_id
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.judge(read_table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = oracles.MERKLE


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.judge(read_table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_repair"] = oracles.CONVERSATIONS


@query
def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.judge(read_table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
