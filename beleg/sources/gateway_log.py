"""The gateway's request log, as files or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = (
    "`@timestamp` timestamp, body struct<requestBody: string, responseBody: string, isError: string, log: string>, "
    "trace_id string, span_id string, request_id string"
)


def flatten_log(raw: DataFrame) -> DataFrame:
    """ts, request_body, response_body, gateway_error, log and the three ids."""
    return raw.select(
        F.col("@timestamp").alias("ts"), F.col("body.requestBody").alias("request_body"),
        F.col("body.responseBody").alias("response_body"), F.col("body.isError").alias("gateway_error"),
        F.col("body.log").alias("log"), "trace_id", "span_id", "request_id",
    )


def read_gateway_log(spark: SparkSession, path: str) -> DataFrame:
    return flatten_log(spark.read.schema(RAW_SCHEMA).json(path))


def stream_gateway_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return flatten_log(spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files).json(path))
