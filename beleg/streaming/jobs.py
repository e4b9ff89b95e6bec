"""Running streams to the end of what is available."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"

BatchHandler = Callable[[DataFrame, int], None]


def with_lateness(stream: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Event time as a UTC timestamp with the watermark; rows later than that are dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def run_available(stream: DataFrame, handler: BatchHandler, checkpoint: str, mode: str = "append") -> int:
    """Process what is there in micro-batches through ``handler`` and stop; progress is kept.

    Returns the number of rows that were dropped for coming after the watermark.
    """
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)


def append_available(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Append what is there to a parquet table, exactly once per row, and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_COMMITS = "version int, checkpoint string, batch_id long"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(version, checkpoint, batch_id) of the finished versions of a table; none before the first."""
    try:
        return spark.read.schema(_COMMITS).json(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def write_version(path: str, checkpoint: str, batch: DataFrame, batch_id: int, make: Callable[[int | None], DataFrame]) -> None:
    """One more version of a table, from the last finished one; it counts once its commit is written.

    Versions are numbered in the table, not by the stream, so a stream under a new checkpoint goes on where the last one
    ended. A batch that is replayed after its commit is skipped; before it, its folder is written anew.
    """
    done = committed(batch.sparkSession, path)
    if not done.filter((F.col("checkpoint") == checkpoint) & (F.col("batch_id") == batch_id)).isEmpty():
        return
    last = done.agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    make(last).write.mode("overwrite").parquet(f"{path}/version={version}")
    batch.sparkSession.createDataFrame([(version, checkpoint, batch_id)], _COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")


def update_table(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Write every update of an aggregating stream as a version (see ``current_rows``); returns the number of late rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(path, checkpoint, batch, batch_id, lambda last: batch)

    return run_available(stream, write, checkpoint, "update")


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*").join(committed(spark, path).select("version"), "version", "left_semi")
    values = [c for c in rows.columns if c not in {*keys, "version"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("version").cast("bigint")).alias("_row")).select(
        *keys, *(F.col(f"_row.{c}").alias(c) for c in values)
    )
