"""C14: turn a long batch table into a directory-partitioned CSV feed that a
file stream can replay, and the schema to read it back with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of one feed file at most, so a stream can bound its micro-batches.
MAX_RECORDS_PER_FILE = 1_000_000


def year_to_timestamp(c: str) -> F.Column:
    """Integer year -> midnight of 1 January (session time zone)."""
    return F.to_timestamp(F.col(c).cast("string"), "yyyy")


def write_stream_feed(df: DataFrame, path: str, part_col: str = "Year", year_int: bool = True,
                      max_records_per_file: int = MAX_RECORDS_PER_FILE, replace: str = "all") -> str:
    """Write ``df`` as headed CSV, one folder per value of ``part_col``.

    replace ``all``: the feed becomes exactly ``df``.  ``present``: only the
        folders of values that ``df`` holds are replaced (dynamic partition
        overwrite); the files of all others stay as they are, so single years
        are published or corrected without the rest.

    year_int: ``part_col`` holds an integer year; it becomes a timestamp
        (``Year=2005-01-01 00%3A00%3A00``), as the stream reads event time.

    Rows are rebalanced by folder: adaptive execution cuts a large folder into
    writer tasks of ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and
    gathers small ones, so writers grow with the bytes and a year that holds a
    third of the rows is still written in parallel.
    """
    out = df.withColumn(part_col, year_to_timestamp(part_col)) if year_int else df
    modes = {"all": "static", "present": "dynamic"}
    if replace not in modes:
        raise ValueError("replace must be 'all' or 'present'")
    (out.hint("rebalance", part_col).write.mode("overwrite").option("partitionOverwriteMode", modes[replace]).partitionBy(part_col)
     .option("maxRecordsPerFile", max_records_per_file).option("header", True).csv(path))
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def in_time_order(spark: SparkSession, path: str) -> str:
    """Give the files of a feed file times in the order of their folders, so a
    file stream reads a folder's files before those of the next folder.
    Folder names must sort by time.  A store that does not keep the times
    (object stores) is an error: days would arrive in any order, and a
    watermark would drop rows of those that come last."""
    jvm = spark.sparkContext._jvm
    fs = _file_system(spark, path)
    found, files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(path), True), []
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith(("_", ".")):
            files.append((file.getParent().toString(), file.getName(), file))
    start = jvm.java.lang.System.currentTimeMillis()
    for i, (_, _, file) in enumerate(sorted(files, key=lambda f: f[:2])):
        fs.setTimes(file, start + i, -1)
        if fs.getFileStatus(file).getModificationTime() != start + i:
            raise RuntimeError(f"{path}: the file system does not keep file times, so the feed cannot be read in time order")
    return path


def feed_schema(data: T.StructType, part_col: str = "Year",
                part_type: T.DataType = T.TimestampType()) -> T.StructType:
    """The schema a feed written by ``write_stream_feed`` must be read with:
    the data columns in file order, then the folder column.

    Binding is by position; a schema in another order silently moves values
    between columns (Country would hold attainment labels).  Read with
    ``enforceSchema=false`` so a wrong order fails on the header instead.
    """
    fields = [f for f in data.fields if f.name != part_col]
    return T.StructType(fields + [T.StructField(part_col, part_type, True)])
