"""The request log and feedback as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.operators.gateway_log import error_counts, failures, parse_requests, request_counts, streaming_percentiles
from beleg.sources.feedback import feedback_entries
from beleg.streaming.jobs import with_lateness


def request_metrics(log: DataFrame) -> DataFrame:
    """Calls by method per five minutes, late rows dropped."""
    return request_counts(with_lateness(log))


def error_metrics(log: DataFrame) -> DataFrame:
    return error_counts(with_lateness(log))


def latency_metrics(log: DataFrame, exact: bool = True) -> DataFrame:
    return streaming_percentiles(with_lateness(log), exact)


def live_questions(log: DataFrame) -> DataFrame:
    """Parsed questions as they come, with their day for partitioning; no state."""
    return parse_requests(log).select("ts", F.to_date("ts").alias("day"), "tool", "args", "request_id")


def live_failures(log: DataFrame) -> DataFrame:
    return failures(log).withColumn("day", F.to_date("ts"))


def feedback_stream(entries: DataFrame) -> DataFrame:
    """Feedback entries ready to be appended by day."""
    return feedback_entries(entries)
