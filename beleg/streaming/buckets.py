"""A table of the latest record per key, in buckets by the hash of the key; a batch rewrites the buckets that it touches.

Every version has a manifest that names, for each bucket, the version whose file is live; a version counts once its commit is
written, so a reader never sees a half-replaced table, and a batch that is replayed after its commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beleg.operators.documents import latest_by_id

BUCKETS = 16
_COMMITS = "version int, checkpoint string, batch_id long, top long, buckets int"
_LIVE = "bucket int, version int"


class State(NamedTuple):
    """The last finished version (None before the first), its live files, the largest sequence number, the number of buckets."""

    version: int | None
    live: dict[int, int]
    top: int | None
    buckets: int | None


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMITS).json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def state_of(spark: SparkSession, path: str) -> State:
    last = _commits(spark, path).orderBy(F.col("version").desc()).first()
    if last is None:
        return State(None, {}, None, None)
    live = spark.read.schema(_LIVE).json(f"{path}/manifests/version={last['version']}").collect()  # a row for each bucket
    return State(last["version"], {r["bucket"]: r["version"] for r in live}, last["top"], last["buckets"])


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that a batch touches: at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect())


def read_buckets(spark: SparkSession, path: str, schema: str, only: Sequence[int] | None = None, state: State | None = None) -> DataFrame:
    """The table, or the files of some buckets of it."""
    state = state_of(spark, path) if state is None else state
    paths = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(state.live.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(
    path: str, schema: str, batch: DataFrame, checkpoint: str, batch_id: int, key: str = "doc_id", seq: str = "ingest_seq", buckets: int = BUCKETS,
) -> State:
    """Put the records of a batch into the table; of each key the record with the largest ``seq`` stays.

    The number of buckets is that of the first version. One writer at a time, as a stream is.
    """
    spark = batch.sparkSession
    state = state_of(spark, path)
    if not _commits(spark, path).filter((F.col("checkpoint") == checkpoint) & (F.col("batch_id") == batch_id)).isEmpty():
        return state
    n = state.buckets or buckets
    batch = batch.persist()
    try:
        touched = buckets_of(batch, key, n)
        if not touched:
            return state
        current = read_buckets(spark, path, schema, touched, state)
        merged = latest_by_id(current.unionByName(batch.select(*current.columns)), key, seq)
        version = 0 if state.version is None else state.version + 1
        placed = merged.withColumn("bucket", bucket_of(F.col(key), n)).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
        top = max(x for x in (state.top, batch.agg(F.max(seq)).first()[0], -1) if x is not None)
    finally:
        batch.unpersist()
    live = state.live | dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(live.items()), _LIVE).coalesce(1).write.mode("overwrite").json(f"{path}/manifests/version={version}")
    spark.createDataFrame([(version, checkpoint, batch_id, top, n)], _COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")
    return State(version, live, top, n)
