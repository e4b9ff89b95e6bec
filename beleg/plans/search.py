"""The three questions a caller asks: search, timeline, charts. Each is one lazy plan per batch.

``passages`` is flat: passage_id, text, title, file_type, language, media_type, created_at,
last_updated_at. ``queries(query_id, question)``, ``requests(request_id, metric, start_year,
end_year)`` and ``topics(topic_id, topic)`` are DataFrames, so a batch fans out by
``explode`` instead of a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.functions.markers import MAX_TIMELINE_YEARS, PROBE_RESULTS, PROBE_TEMPLATES, RETRIEVAL_BREADTH
from beleg.operators.annotate import annotate_passages, project_passages
from beleg.operators.catalogue import attach_download_urls
from beleg.operators.charts import charts_from_passages
from beleg.operators.ranking import dedupe, intern_sources, rank_hits, sources_of, top_per_scope, with_source_json
from beleg.operators.retrieval import retrieve
from beleg.sources.hits import source_record
from beleg.sources.postings import Postings, retrieve_indexed


class Answer(NamedTuple):
    """Items with a ``source_id``, the shared sources they name, and counts per request."""

    items: DataFrame
    sources: DataFrame
    summary: DataFrame


def _check_range(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def ranked_passages(
    queries: DataFrame, passages: DataFrame, limit: int, hits: DataFrame | None = None, corpus: DataFrame | None = None,
    index: Postings | None = None,
) -> DataFrame:
    """Retrieve, rank, collapse copies, cut: query_id, pos, passage_id, score, text, title, ...

    The limit applies after the copies are collapsed, so a copy never takes a slot. Text is
    fetched for the retrieved rows only, in one pass over the passages. With a stored index of the passages only
    the postings of asked words are read to retrieve them.
    """
    if hits is None:
        hits = retrieve(queries, passages, RETRIEVAL_BREADTH, corpus=corpus) if index is None else retrieve_indexed(queries, index)
    ranked = rank_hits(hits.join(passages, "passage_id"))
    return top_per_scope(dedupe(ranked), limit)


def _with_source(rows: DataFrame, publications: DataFrame | None, source_fields: str, key: str = "title") -> DataFrame:
    """Links for the rows that are left, then the projected source record."""
    linked = rows.withColumn("download_url", F.lit(None).cast("string")) if publications is None else attach_download_urls(
        rows, publications, key
    )
    record = source_record(*(F.col(c) for c in (key, "file_type", "language", "media_type", "created_at", "last_updated_at",
                                                "download_url")))
    flat = {"file_type", "language", "media_type", "created_at", "last_updated_at", "download_url"}
    return with_source_json(linked.withColumn("source", record), source_fields=source_fields).drop(*flat, "source")


def counted_for(asked: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Number of items of everything asked: 0 where there is none."""
    counts = items.groupBy(key).agg(F.count("*").alias(name))
    return asked.select(key).distinct().join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def search(
    queries: DataFrame, passages: DataFrame, publications: DataFrame | None = None, max_results: int = 10,
    source_fields: str = "core", hits: DataFrame | None = None, corpus: DataFrame | None = None, index: Postings | None = None,
) -> Answer:
    """Best annotated passages per question with interned sources."""
    _check_range("max_results", max_results, 1, 25)
    best = ranked_passages(queries, passages, max_results, hits, corpus, index)
    items = intern_sources(_with_source(annotate_passages(best), publications, source_fields))
    return Answer(items, sources_of(items), counted_for(queries, items, "query_id", "result_count"))


def timeline_queries(requests: DataFrame) -> DataFrame:
    """One question per request and year; a bad range fails the job with its reason."""
    span = F.col("end_year") - F.col("start_year") + 1
    backwards = F.format_string("the range ends in %s, before it starts in %s", "end_year", "start_year")
    too_long = F.format_string(f"%s years from %s on are asked for, {MAX_TIMELINE_YEARS} are allowed", span, "start_year")
    checked = F.when(span < 1, F.raise_error(backwards)).when(span > MAX_TIMELINE_YEARS, F.raise_error(too_long)).otherwise(F.sequence("start_year", "end_year"))
    return requests.withColumn("year", F.explode(checked)).select(
        F.concat_ws("|", "request_id", "year").alias("query_id"), "request_id", "start_year", "year",
        F.concat_ws(" ", "metric", "year").alias("question"),
    )


def timeline(
    requests: DataFrame, passages: DataFrame, publications: DataFrame | None = None, max_results_per_year: int = 3,
    detail: str = "index", source_fields: str = "core", corpus: DataFrame | None = None, index: Postings | None = None,
) -> Answer:
    """Passages per year of a metric; equal texts of several years become one entry."""
    _check_range("max_results_per_year", max_results_per_year, 1, 25)
    queries = timeline_queries(requests)
    found = ranked_passages(queries.select("query_id", "question"), passages, max_results_per_year, corpus=corpus, index=index)
    placed = found.join(queries.select("query_id", "request_id", "start_year", F.col("year").alias("queried_year")), "query_id")
    placed = placed.withColumn("pos", (F.col("queried_year") - F.col("start_year")) * max_results_per_year + F.col("pos"))
    merged = dedupe(placed.drop("query_id", "start_year"), "request_id", queried_year="queried_year")
    items = intern_sources(
        _with_source(project_passages(annotate_passages(merged), detail), publications, source_fields), "request_id"
    )
    summary = counted_for(requests, items, "request_id", "result_count").join(
        counted_for(requests, placed, "request_id", "retrieved"), "request_id"
    ).select("request_id", "result_count", (F.col("retrieved") - F.col("result_count")).alias("duplicates_collapsed"))
    return Answer(items, sources_of(items, "request_id"), summary)


def probe_queries(topics: DataFrame, templates: Sequence[str] = PROBE_TEMPLATES) -> DataFrame:
    """One question per topic and template; a blank topic fails the job."""
    wordings = F.array(*(F.replace(F.lit(t), F.lit("{topic}"), F.col("topic")) for t in templates))
    checked = F.when(F.trim("topic") == "", F.raise_error(F.lit("topic must not be empty"))).otherwise(wordings)
    return topics.select("topic_id", F.posexplode(checked).alias("probe", "question")).select(
        F.concat_ws("|", "topic_id", "probe").alias("query_id"), "topic_id", "probe", "question"
    )


def probe_pool(
    topics: DataFrame, passages: DataFrame, templates: Sequence[str] = PROBE_TEMPLATES, corpus: DataFrame | None = None,
    index: Postings | None = None,
) -> DataFrame:
    """Passages of all probes of a topic, copies collapsed: topic_id, pos, score, text, ..."""
    queries = probe_queries(topics, templates)
    found = ranked_passages(queries.select("query_id", "question"), passages, PROBE_RESULTS, corpus=corpus, index=index)
    placed = found.join(queries.select("query_id", "topic_id", "probe"), "query_id").withColumn(
        "pos", F.col("probe") * PROBE_RESULTS + F.col("pos")
    )
    return dedupe(placed.drop("query_id", "probe"), "topic_id")


def best_charts(pool: DataFrame, max_charts: int = 5) -> DataFrame:
    """Parsed charts of a pool, the best ``max_charts`` per topic by score, then position."""
    charts = charts_from_passages(pool.withColumnRenamed("title", "document"))
    ordered = rank_charts(charts)
    return top_per_scope(ordered, max_charts, "topic_id")


def rank_charts(charts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("topic_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "pos", "block_pos")
    return charts.withColumn("_rank", F.row_number().over(order)).drop("pos").withColumnRenamed("_rank", "pos")


def get_charts(
    topics: DataFrame, passages: DataFrame, publications: DataFrame | None = None, max_charts: int = 5,
    source_fields: str = "core", templates: Sequence[str] = PROBE_TEMPLATES, corpus: DataFrame | None = None, index: Postings | None = None,
) -> Answer:
    """Number series about a topic with interned sources."""
    _check_range("max_charts", max_charts, 1, 15)
    charts = best_charts(probe_pool(topics, passages, templates, corpus, index), max_charts).drop("text")
    items = intern_sources(_with_source(charts, publications, source_fields, "document"), "topic_id")
    return Answer(items, sources_of(items, "topic_id"), counted_for(topics, items, "topic_id", "chart_count"))
