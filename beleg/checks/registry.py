"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.checks.fixtures import Inputs
from beleg.session import TABLE_CODEC, configure, shared_dir

Query = Callable[[Inputs], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](Inputs(configure(spark), folder))


def listed(items: Column, *fields: str, inner: str = "=", outer: str = ";") -> Column:
    """An array (of structs) as text, so that results compare as plain columns."""
    if not fields:
        return F.array_join(F.transform(items, lambda x: x.cast("string")), outer)
    return F.array_join(F.transform(items, lambda x: F.concat_ws(inner, *(x[f].cast("string") for f in fields))), outer)


def sorted_map(entries: Column) -> Column:
    return listed(F.array_sort(F.map_entries(entries)), "key", "value")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(d: Inputs, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per session and data folder, as a graph is stored once and queried often."""
    key = (d.spark.sparkContext.applicationId, d.folder, name)
    if key not in _STORED:
        path = shared_dir(d.spark, name)
        build().write.option("compression", TABLE_CODEC).parquet(path)
        _STORED[key] = path
    return d.spark.read.parquet(_STORED[key])


def digest(triples: DataFrame) -> DataFrame:
    """Per predicate: number of triples and an order-independent checksum of them."""
    row = F.md5(F.concat_ws("|", "s", "o", "o_kind", F.coalesce("o_type", F.lit(""))))
    number = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return triples.groupBy("p").agg(F.count("*").alias("n"), F.sum(number).alias("checksum"))


def digest_sql(source: str) -> str:
    return (
        "SELECT p, count(*) AS n, cast(sum(cast('0x' || substring(md5(s || '|' || o || '|' || o_kind || '|' || coalesce(o_type, '')), 1, 8) AS bigint)) AS bigint) AS checksum "
        f"FROM {source} GROUP BY p"
    )
