"""Distributed row numbers.

``row_number()`` over a window with no partition sends the whole table to one
task.  Here the rows are range-partitioned by the ordering columns, sorted
within each partition and written once under the shared checkpoint folder with
their place, so the numbers are fixed whatever is recomputed later.  The
number of partitions follows the data (adaptive execution), no key is hashed.

dense=True:  1..N in order, by the row counts of the partitions before.
dense=False: the place itself (partition and row), unique and in order.

Rows that are equal in all ordering columns are numbered in the order of a hash
of the whole row.  The hash is a second range key, so a heavy value (a third of
the rows, say) is cut over several partitions; only rows that are equal in every
column stay together, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.session import scratch_path

#: ``monotonically_increasing_id`` holds the partition above this bit.
ROW_BITS = 33


def with_row_id(df: DataFrame, order_cols: Sequence[str], id_col: str = "row_id", dense: bool = True) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "row-id")
    (df.withColumn("__tie", F.xxhash64(*df.columns)).repartitionByRange(*order_cols, "__tie").sortWithinPartitions(*order_cols, "__tie")
     .drop("__tie").withColumn("__place", F.monotonically_increasing_id()).write.parquet(path))
    placed = spark.read.parquet(path)
    if not dense:
        return placed.withColumnRenamed("__place", id_col)
    part = F.shiftright("__place", ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "__part long, __before long")
    numbered = placed.join(starts, part == F.col("__part"))
    row = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return numbered.select(*df.columns, (F.col("__before") + row + 1).alias(id_col))
