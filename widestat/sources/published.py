"""Published datasets: headed CSV (the notebooks' format) or Parquet, and the
directory-partitioned feed read back as a batch table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def publish(datasets: Mapping[str, DataFrame], base: str, fmt: str = "csv",
            partition_by: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """Write each named dataset under ``base/<name>`` (overwrite).

    CSV gets a header line; Parquet keeps types and allows pushdown on read.
    Returns ``name -> path``.
    """
    paths = {}
    partition_by = partition_by or {}
    for name, df in datasets.items():
        path = f"{base.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        if fmt == "csv":
            writer.option("header", True).csv(path)
        elif fmt == "parquet":
            writer.parquet(path)
        else:
            raise ValueError("fmt must be 'csv' or 'parquet'")
        paths[name] = path
    return paths


def read_published(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   fmt: str = "csv", infer: bool = False) -> DataFrame:
    """Read a published dataset back.

    With a declared schema there is no inference pass (the notebooks' default
    ``inferSchema`` scans the data twice); ``infer=True`` keeps that behaviour.
    """
    if fmt == "parquet":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_feed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Batch scan of a directory-partitioned CSV feed; the partition column is
    recovered from folder names (``Year=2005-01-01 00%3A00%3A00``).  A filter on
    it prunes folders before any file is opened."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)
