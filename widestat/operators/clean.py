"""C2 measure cleaning and C8 domain profiling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from widestat.functions.cells import MISSING_MARKER, clean_cell_sql
from widestat.sources.wide import year_columns


def clean_measures(df: DataFrame, years: Iterable[int], kind: str = "int",
                   missing: str = "zero", keep_sign: bool = False,
                   drop_keys: Sequence[str] = (), key: str = "key",
                   observation: Observation | None = None) -> DataFrame:
    """Flagged year cells -> numbers, in one projection.

    observation: counts, in the cleaning pass itself, the cells of each year
        column that hold no number (``REASONS``); after the first action on
        the result ``lost_cells`` shows them.  No second pass over the data.

    drop_keys: rows whose key equals one of these exactly are removed first
    (the notebook drops the bare indicator row), and so are rows with a null
    key, as under the notebook's ``=!=``.  Without it null keys stay.
    """
    cols = set(year_columns(years))
    if drop_keys:
        df = df.filter(~F.col(key).isin(list(drop_keys)))
    def clean(c: str) -> Column:
        return F.expr(clean_cell_sql(c, kind, missing, keep_sign))

    if observation is None:
        return df.select(*[clean(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    years = [c for c in df.columns if c in cols]
    both = df.select("*", *[clean(c).alias(f"__clean_{c}") for c in years])
    counts = [F.count_if(_lost(F.col(c), F.col(f"__clean_{c}"), reason)).alias(f"{c}{_OF}{reason}") for c in years for reason in REASONS]
    seen = both.observe(observation, *counts) if counts else both
    return seen.select(*[F.col(f"__clean_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


#: Why a cell holds no number: no text; the missing marker (0 or null by the
#: ``missing`` parameter); text without a digit; digits that are no one number
#: (``1.2.3``, ``1 2``, or beyond the type).
REASONS = ("empty", "missing", "no digits", "not one number")
_OF = ": "


def _lost(cell: Column, number: Column, reason: str) -> Column:
    marked, digits = cell.contains(MISSING_MARKER), cell.rlike("[0-9]")
    return {"empty": cell.isNull(), "missing": marked, "no digits": ~marked & ~digits & number.isNull(),
            "not one number": ~marked & digits & number.isNull()}[reason]


def lost_cells(spark: SparkSession, observation: Observation) -> DataFrame:
    """(column, reason, n): the cells that an observed ``clean_measures`` found
    without a number, after an action has run it; reasons without a cell are
    left out.  A row a column and reason, whatever the data."""
    rows = [(*name.split(_OF), n) for name, n in observation.get.items() if n]
    return spark.createDataFrame(rows, "column string, reason string, n long")


def domain_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values with row counts for each dimension column:
    ``(dimension, value, n)``.  One pass, one shuffle for all columns; the
    per-task partial aggregate folds hot values before the exchange."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.explode(pairs).alias("d"))
            .select("d.dimension", "d.value")
            .groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("n")))
