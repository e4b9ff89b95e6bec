"""Queries over the request log, in batch and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.checks.document_queries import FEEDBACK_SQL, feedback_rows, raw_log, shown_feedback
from beleg.checks.fixtures import ROOT, Inputs
from beleg.checks.oracle_parts import sql
from beleg.checks.registry import query
from beleg.operators import gateway_log as logs
from beleg.operators.extraction import extract_with_gazetteer
from beleg.session import shared_dir
from beleg.sources.feedback import read_feedback
from beleg.sources.gateway_log import stream_gateway_log
from beleg.sources.records import DOCUMENT_SCHEMA, EXTRACTION_SCHEMA, read_log
from beleg.streaming import gateway, ingest
from beleg.streaming.jobs import append_available, current_rows, update_table


def _log(d: Inputs) -> DataFrame:
    return d.gateway_log.withColumn("ts", F.col("ts").cast("timestamp"))


def _at(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


_TOOL = "regexp_extract(request_body, 'name=([^,}]+)', 1)"
_ARGS = "regexp_extract(request_body, 'arguments=\\{(.*)\\}\\}\\}', 1)"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


@query("p15_parse_requests", sql(f"SELECT request_id, {_TOOL} AS tool, {_ARGS} AS args FROM gateway_log WHERE contains(request_body, 'method=tools/call')"))
def parse_requests(d: Inputs) -> DataFrame:
    return logs.parse_requests(_log(d)).select("request_id", "tool", "args")


_FAILED = "gateway_error IS NOT NULL OR contains(response_body, 'isError=true') OR coalesce(contains(log, 'rror'), false)"


@query("p16_filter_failures", sql(f"SELECT request_id, {_TS.format('ts')} AS ts, log, gateway_error FROM gateway_log WHERE {_FAILED} ORDER BY gateway_log.ts DESC, request_id LIMIT 100"))
def filter_failures(d: Inputs) -> DataFrame:
    return logs.filter_failures(_log(d)).select("request_id", _at("ts"), "log", "gateway_error")


@query("a9_questions_ranked", sql(f"""
    SELECT {_TOOL} AS tool, {_ARGS} AS args, count(*) AS asked, {_TS.format('min(ts)')} AS first_seen, {_TS.format('max(ts)')} AS last_seen
    FROM gateway_log WHERE contains(request_body, 'method=tools/call') GROUP BY 1, 2 ORDER BY asked DESC, tool, args LIMIT 100"""))
def questions_ranked(d: Inputs) -> DataFrame:
    return logs.questions_ranked(_log(d)).select("tool", "args", "asked", _at("first_seen"), _at("last_seen"))


@query("a10_questions_asked", sql(f"""
    SELECT {_TS.format('ts')} AS ts, {_TOOL} AS tool, {_ARGS} AS args, request_id FROM gateway_log WHERE contains(request_body, 'method=tools/call')
    ORDER BY gateway_log.ts DESC, request_id LIMIT 200"""))
def questions_asked(d: Inputs) -> DataFrame:
    return logs.questions_asked(_log(d)).select(_at("ts"), "tool", "args", "request_id")


_BUCKET = _TS.format("time_bucket(INTERVAL 5 MINUTES, ts)")
COUNTS_SQL = sql(f"SELECT {_BUCKET} AS window_start, method, count(*) AS calls FROM gateway_log GROUP BY 1, 2")
ERRORS_SQL = sql(f"""
    SELECT {_BUCKET} AS window_start, cast(count_if(status = 404) AS bigint) AS user_errors, cast(count_if(status = 500) AS bigint) AS system_errors,
           cast(count_if(status = 429) AS bigint) AS throttles, cast(count_if(status = 401) AS bigint) AS auth_failures FROM gateway_log GROUP BY 1""")
PERCENTILES_SQL = sql(f"""
    SELECT {_BUCKET} AS window_start, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90,
           round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM gateway_log GROUP BY 1""")


@query("t4_request_metrics_batch", COUNTS_SQL)
def request_counts(d: Inputs) -> DataFrame:
    return logs.request_counts(_log(d)).select(_at("window_start"), "method", "calls")


@query("t4b_error_metrics_batch", ERRORS_SQL)
def error_counts(d: Inputs) -> DataFrame:
    found = logs.error_counts(_log(d))
    return found.withColumn("window_start", _at("window_start"))


@query("t5_latency_percentiles_batch", PERCENTILES_SQL)
def latency_percentiles(d: Inputs) -> DataFrame:
    return logs.latency_percentiles(_log(d)).withColumn("window_start", _at("window_start"))


def _event_stream(d: Inputs) -> DataFrame:
    """The events table read as a stream and shaped like the log."""
    stream = d.spark.readStream.schema(d.events.schema).parquet(f"{d.folder}/events.parque[t]")  # as a glob: the table may be one file
    from beleg.checks.fixtures import FIXTURES

    return d.spark.sql(FIXTURES["gateway_log"], events=stream)


def _final(d: Inputs, stream: DataFrame, name: str, *keys: str) -> DataFrame:
    path, checkpoint = shared_dir(d.spark, name), shared_dir(d.spark, f"{name}-checkpoint")
    update_table(stream, path, checkpoint)
    return current_rows(d.spark, path, keys).withColumn("window_start", _at("window_start"))


@query("t4c_request_metrics_stream", COUNTS_SQL)
def request_metrics(d: Inputs) -> DataFrame:
    return _final(d, gateway.request_metrics(_event_stream(d)), "requests", "window_start", "method")


@query("t5b_latency_percentiles_stream", PERCENTILES_SQL)
def latency_metrics(d: Inputs) -> DataFrame:
    return _final(d, gateway.latency_metrics(_event_stream(d)), "latency", "window_start")


def _live(d: Inputs, shape, name: str) -> DataFrame:
    """Through files in delivery format, a stream, and a table partitioned by day."""
    source, table, checkpoint = (shared_dir(d.spark, f"{name}-{part}") for part in ("source", "table", "checkpoint"))
    raw_log(d).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)
    append_available(shape(stream_gateway_log(d.spark, source)), table, checkpoint, ["day"])
    return d.spark.read.parquet(table)


@query("t6a_live_questions", sql(f"""
    SELECT request_id, {_TS.format('ts')} AS ts, cast(cast(ts AS date) AS varchar) AS day, {_TOOL} AS tool, {_ARGS} AS args
    FROM gateway_log WHERE contains(request_body, 'method=tools/call')"""))
def live_questions(d: Inputs) -> DataFrame:
    return _live(d, gateway.live_questions, "questions").select("request_id", _at("ts"), F.col("day").cast("string").alias("day"), "tool", "args")


@query("t6b_live_failures", sql(f"SELECT request_id, cast(cast(ts AS date) AS varchar) AS day, log, gateway_error FROM gateway_log WHERE {_FAILED}"))
def live_failures(d: Inputs) -> DataFrame:
    return _live(d, gateway.live_failures, "failures").select("request_id", F.col("day").cast("string").alias("day"), "log", "gateway_error")


@query("t7_feedback_stream", FEEDBACK_SQL)
def feedback_stream(d: Inputs) -> DataFrame:
    source, table, checkpoint = (shared_dir(d.spark, f"feedback-{part}") for part in ("source", "table", "checkpoint"))
    rows = feedback_rows(d)
    rows.write.parquet(source)
    stream = d.spark.readStream.schema(rows.schema).parquet(source)
    append_available(gateway.feedback_stream(stream), table, checkpoint, ["day"])
    return shown_feedback(read_feedback(d.spark, table))


def _object_stream(d: Inputs, changed: bool) -> DataFrame:
    """The text objects as a stream; in the later state one in seven has a new version."""
    rows = d.text_objects.select(
        "key", "size", F.encode("body", "utf-8").alias("content"), F.lit(None).cast("timestamp").alias("last_modified"),
        F.when(F.lit(changed) & (F.col("doc_id") % 7 == 0), "new").otherwise(F.col("etag")).alias("etag"),
    )
    source = shared_dir(d.spark, "objects")
    rows.write.parquet(source)
    return d.spark.readStream.schema(rows.schema).parquet(source)


@query("t1_incremental_ingest", sql(f"""
    SELECT '{ROOT}' || key AS source_uri, etag, cast(0 AS bigint) AS ingest_seq FROM text_objects
    UNION ALL SELECT '{ROOT}' || key, 'new', 1 FROM text_objects WHERE doc_id % 7 = 0"""))
def incremental_ingest(d: Inputs) -> DataFrame:
    log = shared_dir(d.spark, "documents")
    for changed in (False, True, True):  # the third run finds nothing to do
        ingest.incremental_ingest(_object_stream(d, changed), log, shared_dir(d.spark, "ingest-checkpoint"), ROOT)
    return read_log(d.spark, log, DOCUMENT_SCHEMA).select("source_uri", "etag", "ingest_seq")


@query("t2_incremental_extract", "SELECT cast(doc_id AS varchar) AS doc_id, cast(0 AS bigint) AS ingest_seq FROM documents WHERE trim(text) <> ''")
def incremental_extract(d: Inputs) -> DataFrame:
    log = shared_dir(d.spark, "extractions")
    labels = d.nation.select(F.col("n_name").alias("label"))
    docs = d.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    source = shared_dir(d.spark, "texts")
    docs.write.parquet(source)
    for _ in range(2):  # a second run extracts nothing again
        stream = d.spark.readStream.schema(docs.schema).parquet(source)
        ingest.incremental_extract(stream, log, shared_dir(d.spark, "extract-checkpoint"), lambda batch: extract_with_gazetteer(batch, labels))
    return read_log(d.spark, log, EXTRACTION_SCHEMA).select("doc_id", "ingest_seq")


@query("t3b_upsert_latest_stream", sql("""
    SELECT doc_id, CASE o_orderstatus WHEN 'F' THEN 'first' ELSE o_orderpriority END AS text FROM graph_docs"""))
def upsert_latest(d: Inputs) -> DataFrame:
    schema = "doc_id string, text string, ingest_seq bigint"
    first = d.graph_docs.select("doc_id", F.lit("first").alias("text"), F.lit(1).cast("bigint").alias("ingest_seq"))
    later = d.graph_docs.filter("o_orderstatus <> 'F'").select("doc_id", F.col("o_orderpriority").alias("text"), F.lit(2).cast("bigint").alias("ingest_seq"))
    source, table, checkpoint = (shared_dir(d.spark, f"upsert-{part}") for part in ("source", "table", "checkpoint"))
    for part in (first, later):
        part.write.mode("append").parquet(source)
        ingest.upsert_latest(d.spark.readStream.schema(schema).parquet(source), table, checkpoint, schema)
    return ingest.latest_version(d.spark, table, schema).select("doc_id", "text")


@query("t3c_upsert_under_a_new_checkpoint", sql("""
    SELECT doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS text FROM graph_docs"""))
def upsert_new_checkpoint(d: Inputs) -> DataFrame:
    schema = "doc_id string, text string, ingest_seq bigint"
    table = shared_dir(d.spark, "upsert-table")
    for n, (text, rows) in enumerate((("first", d.graph_docs), ("second", d.graph_docs.filter("o_orderkey % 3 = 0")))):
        source = shared_dir(d.spark, "upsert-source")
        rows.select("doc_id", F.lit(text).alias("text"), F.lit(n).cast("bigint").alias("ingest_seq")).write.parquet(source)
        ingest.upsert_latest(d.spark.readStream.schema(schema).parquet(source), table, shared_dir(d.spark, "upsert-checkpoint"), schema)
    return ingest.latest_version(d.spark, table, schema).select("doc_id", "text")


@query("t2b_extract_two_versions_in_a_batch", r"""
    WITH w AS (SELECT cast(doc_id AS varchar) AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS label FROM documents WHERE trim(text) <> '')
    SELECT d.doc_id, cast(coalesce(n, 0) AS bigint) AS mentions FROM (SELECT DISTINCT cast(doc_id AS varchar) AS doc_id FROM documents WHERE trim(text) <> '') d
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM w WHERE label IN ('the', 'der', 'de') GROUP BY doc_id) c USING (doc_id)""")
def extract_two_versions(d: Inputs) -> DataFrame:
    log, source = shared_dir(d.spark, "extractions"), shared_dir(d.spark, "texts")
    labels = d.spark.createDataFrame([("the",), ("der",), ("de",)], "label string")
    docs = d.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(2).cast("bigint").alias("ingest_seq"))
    older = docs.withColumn("text", F.concat(F.lit("the the "), "text")).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    docs.union(older).write.parquet(source)
    stream = d.spark.readStream.schema(docs.schema).parquet(source)
    ingest.incremental_extract(stream, log, shared_dir(d.spark, "extract-checkpoint"), lambda batch: extract_with_gazetteer(batch, labels))
    counts = F.aggregate(F.map_values("mention_counts"), F.lit(0).cast("bigint"), lambda total, n: total + n)
    return read_log(d.spark, log, EXTRACTION_SCHEMA).select("doc_id", counts.alias("mentions"))
