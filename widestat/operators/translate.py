"""C5 code -> description lookup, C6 label shortening, C7 relabelling.

The notebooks chained one anchored ``regexp_replace`` per code (hundreds of
plan nodes, regex metacharacters live, a description equal to another code
translated twice).  Here a lookup is an equality join against the code list
without any hint: the planner, and AQE with the real sizes, choose between a
broadcast and a shuffle join by bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.functions.keys import strip_prefix
from widestat.functions.labels import age_band, replace_chain


def lookup_table(codes: DataFrame, code_list: str | None = None, unique: bool = False) -> DataFrame:
    """One row per code: ``(code, description)``.

    Restricted to ``code_list`` when given (codes are unique within a list,
    not across lists).  Duplicates of a code keep the last one in file order,
    so the join can never multiply rows.  ``unique=True`` skips that step for
    code tables keyed by a primary key (the caller's guarantee): no sort-based
    aggregate over a dictionary that grows with the data.
    """
    if code_list is not None:
        codes = codes.filter(F.col("code_list") == F.lit(code_list))
    if unique:
        return codes.select("code", "description")
    order = "code_pos" if "code_pos" in codes.columns else "description"
    return (codes.groupBy("code")
            .agg(F.max_by("description", order).alias("description")))


def translate(df: DataFrame, columns: Mapping[str, str | None] | Sequence[str], codes: DataFrame,
              prefix: str | None = None, sep: str = ",", missing: str = "keep",
              unique_codes: bool = False, row_key: str | None = None) -> DataFrame:
    """Replace codes in ``columns`` by their descriptions.

    columns: ``{column: code_list}`` (``None`` = any list), or a list of columns
        looked up in the whole code table.
    prefix: the value is ``<prefix><sep><code>`` (``GBIRTHRT_THSP,AT``); values
        without that prefix are left alone.
    missing ``keep``: unknown codes, and codes with no description, stay as
        they are; ``empty``: a known code with no description becomes ``''``.
    unique_codes: the code table has one row per (list, code) by construction
        (a primary key); skips the deduplicating aggregate.
    row_key: a unique, non-null column of ``df``.  All columns are then looked
        up by one join of (row, column, code) rows and gathered by row: two
        shuffles whatever the number of columns, where a dictionary too large
        to broadcast costs one shuffle of the whole table for each column
        otherwise.
    Row count is unchanged (left join on a unique key).
    """
    if missing not in ("keep", "empty"):
        raise ValueError("missing must be 'keep' or 'empty'")
    mapping = dict(columns) if isinstance(columns, Mapping) else {c: None for c in columns}
    if row_key is not None:
        return _translate_long(df, mapping, codes, prefix, sep, missing, unique_codes, row_key)
    tables: dict[str | None, DataFrame] = {}
    out = df
    for i, (col, code_list) in enumerate(mapping.items()):
        if code_list not in tables:
            tables[code_list] = lookup_table(codes, code_list, unique_codes)
        k, d = f"__code_{i}", f"__desc_{i}"
        table = tables[code_list].select(F.col("code").alias(k), F.col("description").alias(d))
        probe = strip_prefix(F.col(col), prefix, sep) if prefix else F.col(col)
        joined = out.join(table, probe == F.col(k), "left")
        if missing == "keep":
            new = F.coalesce(F.col(d), F.col(col))
        else:
            new = F.when(F.col(k).isNotNull(), F.coalesce(F.col(d), F.lit(""))).otherwise(F.col(col))
        out = joined.select(*[new.alias(c) if c == col else F.col(c) for c in out.columns])
    return out


def _translate_long(df: DataFrame, mapping: Mapping[str, str | None], codes: DataFrame, prefix: str | None,
                    sep: str, missing: str, unique: bool, row_key: str) -> DataFrame:
    """``translate`` by one join: a row for each (row, column) with its code
    list and code, looked up together, then one conditional aggregate a row."""
    def probe(c: str):
        return strip_prefix(F.col(c), prefix, sep) if prefix else F.col(c)

    cells = df.select(F.col(row_key).alias("__row"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(lst or "").alias("list"), probe(c).alias("code"))
        for i, (c, lst) in enumerate(mapping.items())])).alias("__c")).select("__row", "__c.*")
    tables = [lookup_table(codes, lst, unique).select(F.lit(lst or "").alias("__list"), F.col("code").alias("__code"),
                                                      F.col("description").alias("__desc"))
              for lst in dict.fromkeys(mapping.values())]
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    met = cells.join(table, (F.col("list") == F.col("__list")) & (F.col("code") == F.col("__code")))
    text = F.col("__desc") if missing == "keep" else F.coalesce("__desc", F.lit(""))
    found = met.groupBy("__row").agg(*[F.max(F.when(F.col("i") == i, text)).alias(f"__new_{i}") for i in range(len(mapping))])
    joined = df.join(found, F.col(row_key) == F.col("__row"), "left")
    new = {c: F.coalesce(F.col(f"__new_{i}"), F.col(c)) for i, c in enumerate(mapping)}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def shorten(df: DataFrame, col: str, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Ordered literal substring replacement on ``col`` (one projection)."""
    return df.withColumn(col, replace_chain(col, pairs))


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str | None]) -> DataFrame:
    """Whole-value relabelling with an explicit mapping (no pairing by the
    order of a ``distinct().collect()``), of any length: one lookup join.  A
    value that the mapping holds takes its label, also a null one; all others
    stay."""
    if not mapping:
        return df
    table = df.sparkSession.createDataFrame(list(mapping.items()), "__orig string, __label string")
    joined = df.join(table, F.col(col) == F.col("__orig"), "left")
    new = F.when(F.col("__orig").isNotNull(), F.col("__label")).otherwise(F.col(col))
    return joined.select(*[new.alias(c) if c == col else F.col(c) for c in df.columns])


def relabel_age(df: DataFrame, col: str = "Age") -> DataFrame:
    """``From a to b years`` -> ``a-b``."""
    return df.withColumn(col, age_band(col))
