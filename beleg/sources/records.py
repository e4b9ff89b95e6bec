"""Append-only record logs and the manifest.

Task commits replace fsync and orphan-line repair; a reader skips what is no valid record
and can report how many lines that were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_SCHEMA = (
    "doc_id string, source_uri string, content_type string, size_bytes bigint, text string, text_truncated boolean, "
    "properties map<string,string>, etag string, ingest_seq bigint"
)
EXTRACTION_SCHEMA = (
    "doc_id string, entities array<string>, relations array<struct<s:string,p:string,o:string>>, model string, "
    "extracted_at timestamp, mention_counts map<string,bigint>, ingest_seq bigint"
)


def parse_records(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Typed records of JSON lines with ``_corrupt_record`` set on malformed ones; blanks vanish."""
    parsed = lines.filter(F.trim(value) != "").select(
        F.from_json(value, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")
    )
    return parsed.select("r.*")


def valid_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def corrupt_count(records: DataFrame) -> DataFrame:
    """One row: records read and lines skipped."""
    bad = F.col("_corrupt_record").isNotNull()
    return records.agg(F.count_if(~bad).alias("records"), F.count_if(bad).alias("skipped"))


def read_log(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Every record of the log, all versions; ``latest_by_id`` replays it."""
    return valid_records(parse_records(spark.read.text(path), schema))


def append_log(df: DataFrame, path: str) -> None:
    """Append self-contained records, one JSON object per line."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, etag string").parquet(path)


def write_manifest(objects: DataFrame, path: str) -> None:
    """The last step of a build: only a finished graph marks its objects as processed."""
    objects.select("key", "etag").write.mode("overwrite").parquet(path)
