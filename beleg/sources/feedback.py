"""Feedback entries: one partition per UTC day, append only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.functions.markers import FEEDBACK_FIELDS, NOT_PROVIDED
from beleg.functions.text import strip

SCHEMA = "ts timestamp, user_question string, answer string, user_reaction string, source string, extra map<string,string>"


def _provided(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(NOT_PROVIDED)).otherwise(strip(value))


def feedback_entries(df: DataFrame) -> DataFrame:
    """Known fields first, in fixed order, extras kept, absent values marked; with the day."""
    extra = F.col("extra") if "extra" in df.columns else F.create_map().cast("map<string,string>")
    return df.select(
        "ts", *(_provided(F.col(f)).alias(f) for f in FEEDBACK_FIELDS),
        F.transform_values(extra, lambda k, v: _provided(v)).alias("extra"), F.to_date("ts").alias("day"),
    )


def render_entry(df: DataFrame) -> DataFrame:
    """The entries as Markdown text, one column ``entry``."""
    lines = [F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))]
    lines += [F.concat(F.lit(f"**{f}**\n\n"), F.col(f)) for f in FEEDBACK_FIELDS]
    extras = F.transform(F.map_entries("extra"), lambda e: F.concat(F.lit("**"), e["key"], F.lit("**\n\n"), e["value"]))
    return df.withColumn("entry", F.concat(F.array_join(F.concat(F.array(*lines), F.coalesce(extras, F.array().cast("array<string>"))), "\n\n"), F.lit("\n")))


def append_feedback(df: DataFrame, path: str) -> None:
    """Append by day; concurrent writers add files and lose nothing."""
    feedback_entries(df).write.mode("append").partitionBy("day").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", day date").parquet(path)
