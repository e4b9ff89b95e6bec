"""Session settings the engine relies on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Semantics, not tuning: side-car entries win over front matter in map_concat, and every
# timestamp is UTC.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Runtime re-planning: skewed join partitions are split, small sides found at run time are
# broadcast under Spark's own size threshold, shuffle partitions are coalesced to a size.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Tables of IRIs repeat namespaces and hold hashes in hexadecimal digits, which Spark's own choice stores at twice the size.
TABLE_CODEC = "zstd"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in {**SEMANTIC_SETTINGS, **ADAPTIVE_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stream checkpoints and intermediate tables.

    The cluster names its shared file system in ``spark.checkpoint.dir``. Only where that
    is unset and Spark runs in one JVM (tests) is a machine-local folder acceptable.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    A stage that several later steps refer to would otherwise be planned, and run, once per
    reference; the written table also survives the loss of executors.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", TABLE_CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
