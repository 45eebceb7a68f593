"""Helpers shared by the document operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from widestat.session import drop_scratch, scratch_path

# Functions of this subpackage travel to the executors by value, so the workers
# need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["widestat.llm"])

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = "\t\n\x0b\x0c\r "
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row.  A plain
    reference inside a higher-order function may be inlined by the optimizer
    and then run once for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` under the shared checkpoint folder and
    read it back.  The written table survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends; else they stay
    until the driver happens to collect its garbage.  For code whose results
    are all written before they are read again."""
    before = spark.conf.get(SHUFFLES_DROPPED, None)
    spark.conf.set(SHUFFLES_DROPPED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_DROPPED)
        else:
            spark.conf.set(SHUFFLES_DROPPED, before)


class Scratch:
    """Written intermediates of one operator, dropped when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *results: DataFrame) -> None:
        """Drop those of ``results`` that were written here; they are not read again."""
        for df in results:
            if id(df) in self.paths:
                drop_scratch(self.spark, self.paths.pop(id(df))[1])

    def drop_all_but(self, result: DataFrame) -> None:
        for out, path in self.paths.values():
            if out is not result:
                drop_scratch(self.spark, path)
        self.paths = {k: v for k, v in self.paths.items() if v[0] is result}


def worker_cached(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, once for the Python worker that runs the task: Spark reuses
    its workers, so a model is loaded and a cache warmed once, not for every
    task.  What is kept must bound itself and change no result."""
    held = sys.modules.setdefault("_document_operators_held", types.ModuleType("_document_operators_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
