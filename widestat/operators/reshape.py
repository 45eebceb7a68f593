"""C9 wide -> long, C11 stratum cross-tabulation, and key-value rows -> columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widestat.functions.sql import ident, literal
from widestat.sources.wide import year_columns

MAX_VALUES_CONF = "spark.sql.pivotMaxValues"


def wide_to_long(df: DataFrame, ids: Sequence[str], years: Iterable[int], var: str = "Year",
                 value: str = "value", var_type: str = "int") -> DataFrame:
    """One row per (ids, year); null cells are kept as null rows.

    ``unpivot`` is a single Expand node: no map column, no shuffle.
    """
    long = df.unpivot(list(ids), year_columns(years), var, value)
    return long.withColumn(var, F.col(var).cast(var_type))


def discover_values(df: DataFrame, col: str, max_values: int | None = None) -> list:
    """The distinct values of ``col`` in order, null first: the columns of a
    pivot whose values nobody declared.

    A job of its own that reads this one column; every task folds its values,
    and no more than ``max_values`` + 1 (``spark.sql.pivotMaxValues`` when not
    given) reach the driver.  More distinct values are an error, as are
    two whose text is the same (null and ``'null'``), which would share a column.
    """
    most = int(df.sparkSession.conf.get(MAX_VALUES_CONF)) if max_values is None else max_values
    found = [r[0] for r in df.select(col).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} distinct values ({MAX_VALUES_CONF}); declare the values or raise the limit")
    found.sort(key=lambda v: (v is not None, v if v is not None else 0))
    names = [column_name(v) for v in found]
    if len(set(names)) < len(names):
        raise ValueError(f"{col} has different values with the same text: {sorted(n for n in names if names.count(n) > 1)}")
    return found


def column_name(value: object) -> str:
    """The column of a pivoted value: its text, ``null`` for null."""
    if isinstance(value, bool):
        return str(value).lower()
    return "null" if value is None else str(value)


def _listed(df: DataFrame, pivot_col: str, values: Sequence[str], unlisted: str) -> DataFrame:
    if unlisted == "drop":
        return df
    if unlisted != "fail":
        raise ValueError("unlisted must be 'drop' or 'fail'")
    col = F.col(pivot_col)
    message = F.concat(F.lit(f"{pivot_col} holds a value without a column: "), F.coalesce(col.cast("string"), F.lit("null")))
    known = col.isin([v for v in values if v is not None])
    return df.withColumn(pivot_col, F.when(known | col.isNull() if None in values else known, col).otherwise(F.raise_error(message)))


def _is_value(pivot_col: str, value: object) -> str:
    if value is None:
        return f"{ident(pivot_col)} IS NULL"
    return f"{ident(pivot_col)} = {literal(value)}" if isinstance(value, str) else f"CAST({ident(pivot_col)} AS STRING) = {literal(column_name(value))}"


def _pivot_sums(pivot_col: str, values: Sequence, measure: str) -> list[Column]:
    # Conditional sums are what a pivot with a value list computes; written out
    # they stay one hash aggregate (partial per task, one exchange).  A group
    # with no rows for a value, or only null measures, gives null.
    return [F.expr(f"sum(CASE WHEN {_is_value(pivot_col, v)} THEN {ident(measure)} END)").alias(column_name(v))
            for v in values]


def _no_clash(rows: Sequence[str], pivot_col: str, values: Sequence) -> None:
    taken = sorted(set(rows) & {column_name(v) for v in values})
    if taken:
        raise ValueError(f"values of {pivot_col} would repeat the columns {taken}")


def crosstab(df: DataFrame, rows: Sequence[str], pivot_col: str, values: Sequence[str] | None,
             measure: str, band_col: str | None = None, bands: Sequence[str] | None = None,
             unlisted: str = "drop", max_values: int | None = None) -> DataFrame:
    """Filter to ``bands`` of ``band_col`` (when given), then one column per
    value of ``pivot_col`` holding the sum of ``measure`` per ``rows``.

    Values not in ``values`` (including null) make no column; with
    ``unlisted="fail"`` such a row among those that are summed is an error.
    With ``values=None`` the values are found first (``discover_values``, after
    the band filter): every one is a column, in order, null too (``null``).  A
    value that arrives between the two passes is an error, not a loss.
    """
    if band_col is not None and bands is not None:
        df = df.filter(F.col(band_col).isin(list(bands)))
    if values is None:
        values, unlisted = discover_values(df, pivot_col, max_values), "fail"
        _no_clash(rows, pivot_col, values)
    df = _listed(df, pivot_col, values, unlisted)
    return df.groupBy(*rows).agg(*_pivot_sums(pivot_col, values, measure)) if values else df.select(*rows).distinct()


def stratum_crosstab(df: DataFrame, strata: Mapping[str, Sequence[str]], band_col: str,
                     rows: Sequence[str], pivot_col: str, values: Sequence[str] | None, measure: str,
                     stratum_col: str = "stratum", unlisted: str = "drop", max_values: int | None = None) -> DataFrame:
    """All strata in one aggregation, keyed by ``stratum_col``.

    Each stratum is a list of bands; its row holds the sums over those bands
    (two bands' shares are added, as in the notebooks).  Disjoint strata tag
    each row with one name (a filter on the stratum then reaches the scan);
    overlapping strata explode a row into each stratum it belongs to.  With
    ``values=None`` the columns are the values found in any stratum.
    """
    band = F.col(band_col)
    owners: dict[str, list[str]] = {}
    for name, bands in strata.items():
        for b in bands:
            owners.setdefault(b, []).append(name)
    if values is None:
        values, unlisted = discover_values(df.filter(band.isin(list(owners))), pivot_col, max_values), "fail"
        _no_clash([stratum_col, *rows], pivot_col, values)
    if all(len(v) == 1 for v in owners.values()):
        tag = None
        for name, bands in strata.items():
            cond = band.isin(list(bands))
            tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
        tagged = df.filter(band.isin(list(owners))).withColumn(stratum_col, tag)
    else:
        names = F.array(*[F.when(band.isin(list(bands)), F.lit(name)) for name, bands in strata.items()])
        tagged = df.withColumn(stratum_col, F.explode(F.filter(names, lambda x: x.isNotNull())))
    tagged = _listed(tagged, pivot_col, values, unlisted)
    if not values:
        return tagged.select(stratum_col, *rows).distinct()
    return tagged.groupBy(stratum_col, *rows).agg(*_pivot_sums(pivot_col, values, measure))


def gather(df: DataFrame, rows: Sequence[str], name_col: str, value_col: str, names: Sequence[str] | None = None,
           max_values: int | None = None) -> DataFrame:
    """Key-value rows -> one row per ``rows`` with a column for each name
    (``groupBy(rows).pivot(name).agg(first(value))``).

    Without ``names`` they are found first, in order.  Of several values of one
    name in a row the least is taken, so the result does not depend on the
    order of the rows; a name without a value is null.
    """
    if names is None:
        names = discover_values(df, name_col, max_values)
        _no_clash(rows, name_col, names)
    if not names:
        return df.select(*rows).distinct()
    return df.groupBy(*rows).agg(*[
        F.expr(f"min(CASE WHEN {_is_value(name_col, n)} THEN {ident(value_col)} END)").alias(column_name(n)) for n in names])
