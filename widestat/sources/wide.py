"""Wide statistical tables: one composite key column + one text column per year."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def year_columns(years: Iterable[int]) -> list[str]:
    return [str(y) for y in years]


def wide_schema(years: Iterable[int], key: str = "key") -> T.StructType:
    """``key`` plus one string column per year, all strings (cells carry flags)."""
    return T.StructType(
        [T.StructField(key, T.StringType(), True)]
        + [T.StructField(y, T.StringType(), True) for y in year_columns(years)]
    )


def read_wide(spark: SparkSession, path: str, years: Iterable[int], key: str = "key",
              sep: str = "\t") -> DataFrame:
    """Scan a wide TSV (or a folder of them); year columns bind by their names
    in the header, blanks around a name ignored, in any order.

    The first column is the key, whatever its header says.  The years of the
    header must be exactly ``years``: a missing, extra or repeated year fails
    here.  Every file's header must equal the first one's, or the scan fails.
    No inference pass over the data; the header costs one small read.
    """
    wanted = year_columns(years)
    reader = spark.read.option("sep", sep).option("header", True)
    header = reader.csv(path).columns
    named = [name.strip() for name in header[1:]]
    if sorted(named) != sorted(wanted):
        raise ValueError(f"{path}: the header has the years {named}, not {wanted}")
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in header])
    rows = reader.schema(schema).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    place = {name: i + 1 for i, name in enumerate(named)}
    rows = rows.toDF(*[f"c{i}" for i in range(len(header))])
    return rows.select(F.col("c0").alias(key), *[F.col(f"c{place[y]}").alias(y) for y in wanted])


def write_wide(df: DataFrame, path: str, sep: str = "\t") -> str:
    """Write a wide table as headed TSV files (overwrite)."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
    return path


def preview(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """First ``n`` raw lines of a source file, for a look before declaring a schema."""
    return spark.read.text(path).limit(n)
