"""Reading the given tables, cutting lineage, and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beleg.session import cut_lineage

__all__ = ["content_hash", "cut_lineage", "map_rows", "read_table", "row_key", "spare_name"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def row_key(*columns: str) -> tuple[Column, Column]:
    """128 bits that depend on nothing but the row, so that they are the same in every scan and after every lost executor."""
    return F.xxhash64(F.lit("a"), *columns).alias("k1"), F.xxhash64(*columns[::-1], F.lit("b")).alias("k2")


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns: an order of rows with equal keys that doesn't depend on how they are partitioned."""
    unhashable = ("map<", "variant")
    columns = [F.col(f"`{name}`") for name, _ in df.dtypes]
    return F.xxhash64(*(F.to_json(F.struct(c)) if any(u in kind for u in unhashable) else c for c, (_, kind) in zip(columns, df.dtypes)))


def map_rows(df: DataFrame, schema: str | T.StructType, function: Callable[..., Iterator[dict]], *columns: str) -> DataFrame:
    """Arrow batches through a function that gets the named columns as lists and yields dicts of lists (NumPy or Arrow arrays).

    Only the named columns are sent to Python.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in function(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                columns = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.select(*columns).mapInArrow(run, schema)
