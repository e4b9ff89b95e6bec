"""Raw retrieval hits (nested) to flat passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beleg.operators.annotate import published_at

RAW_SCHEMA = (
    "score double, content struct<text: string>, metadata struct<_document_title: string, _file_type: string, "
    "_language_code: string, _media_type: string, _created_at: string, _last_updated_at: string>, "
    "location struct<type: string, s3Location: struct<uri: string>, webLocation: struct<url: string>>"
)


def source_record(title: Column, file_type: Column, language: Column, media_type: Column, created_at: Column,
                  last_updated_at: Column, download_url: Column | None = None) -> Column:
    """The source struct every passage carries; the link is filled in after the limit."""
    url = F.lit(None).cast("string") if download_url is None else download_url
    return F.struct(
        title.alias("title"), published_at(title).alias("published_at"), url.alias("download_url"),
        file_type.alias("file_type"), language.alias("language"), media_type.alias("media_type"),
        created_at.alias("created_at"), last_updated_at.alias("last_updated_at"),
    )


def flatten_hits(raw: DataFrame, json: str | None = None) -> DataFrame:
    """query_id, rank, score, text, source. ``json`` names a column holding raw hits as text."""
    hits = raw if json is None else raw.select(
        "query_id", "rank", F.from_json(json, RAW_SCHEMA).alias("h")
    ).select("query_id", "rank", "h.*")
    m = {n: F.col(f"metadata.{n}") for n in ("_document_title", "_file_type", "_language_code", "_media_type",
                                             "_created_at", "_last_updated_at")}
    return hits.select("query_id", "rank", "score", F.coalesce("content.text", F.lit("")).alias("text"),
                       source_record(*m.values()).alias("source"))


def flatten_hits_with_location(raw: DataFrame) -> DataFrame:
    """The variant that keeps where a hit is stored instead of its source record."""
    return raw.select(
        "query_id", "rank", "score", F.coalesce("content.text", F.lit("")).alias("text"),
        F.struct(F.col("location.type").alias("type"), F.col("location.s3Location.uri").alias("uri"),
                 F.col("location.webLocation.url").alias("web_location")).alias("source"), "metadata",
    )
