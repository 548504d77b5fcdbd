"""Shared plumbing of the training-data operators: table access and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import bounded_batches, cut, discard, shared_dir

__all__ = ["bounded_batches", "cut", "discard", "identity", "materialize", "packed", "quoted", "shared_dir", "small", "small_batches", "table"]

#: Tables of up to so many rows of two or three numbers (some 40 bytes each in a hash table) are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, always alike, and ship the code of Python workers."""
    bounded_batches(spark)


def packed(df: DataFrame, name: str = "gl_row") -> DataFrame:
    """df as one struct column, so that joins beside it cannot clash with its columns' names."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identity(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart, as two numbers."""
    return F.xxhash64(text), F.xxhash64(F.lit(20_011), text)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; see storage.cut.

    codec: zstd is for tables of text; its buffers lie outside of the heap, so tables of numbers go without.
    """
    return cut(df, label, codec)


def small(df: DataFrame) -> DataFrame:
    """df, a table of a few numbers a row, marked for broadcast if a count shows that it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
