"""C3 composite key -> named columns, its long (pivot-and-join) form, and
C10 slicing a cube at fixed dimension values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.functions.keys import key_part, key_parts
from widestat.operators.reshape import discover_values, gather


def split_key(df: DataFrame, key: str, names: Sequence[str], sep: str = ",",
              keep_key: bool = False) -> DataFrame:
    """One projection: part ``i`` of ``key`` becomes column ``names[i]``.

    Missing parts are null (ragged keys), extra parts are ignored.  No row id,
    no shuffle, and no way for codes to drift to another row's measures.
    """
    rest = [F.col(c) for c in df.columns if c != key or keep_key]
    parts = [key_part(F.col(key), i, sep).alias(n) for i, n in enumerate(names)]
    return df.select(*parts, *rest)


def split_key_pivot_form(df: DataFrame, key: str, names: Sequence[str] | None, sep: str = ",",
                         max_values: int | None = None) -> DataFrame:
    """``split_key`` by way of the long form: a row for each part of each
    distinct key, gathered again by a pivot on the part's name (``code0``,
    ``code1``, ...), joined back on the key itself.  Needs no row number.  Rows
    with a null key drop out.

    Without ``names`` the parts keep those names, as many as the longest key
    has (found by a first pass); with them part ``i`` becomes ``names[i]`` and
    parts beyond are left out.
    """
    tall = df.select(F.col(key).alias("__key")).distinct().select(
        "__key", F.posexplode(key_parts(F.col("__key"), sep)).alias("__place", "__part"))
    tall = tall.withColumn("__name", F.concat(F.lit("code"), F.col("__place").cast("string")))
    if names is None:
        codes = sorted((v for v in discover_values(tall, "__name", max_values)), key=lambda v: (len(v), v))
        names = codes
    else:
        codes = [f"code{i}" for i in range(len(names))]
    wide = gather(tall, ["__key"], "__name", "__part", codes)
    joined = df.join(wide, df[key] == wide["__key"]).drop(df[key]).drop(wide["__key"])
    measures = [df[c] for c in df.columns if c != key]
    return joined.select(*[wide[c].alias(n) for c, n in zip(codes, names)], *measures)


def restrict(df: DataFrame, fixed: Mapping[str, str], drop: Sequence[str] = (),
             sum_over: Sequence[str] = ()) -> DataFrame:
    """Slice a cube at fixed values (``{"Citizen": "Total"}``) and drop the
    spent dimensions.

    A dimension may be dropped without fixing it only when it is named in
    ``sum_over``: later aggregates then add across its values on purpose.
    """
    loose = [c for c in drop if c not in fixed and c not in sum_over]
    if loose:
        raise ValueError(f"dropping {loose} without a fixed value would sum across them; "
                         "fix a value or name them in sum_over")
    for col, value in fixed.items():
        df = df.filter(F.col(col) == F.lit(value))
    gone = set(fixed) | set(drop) | set(sum_over)
    return df.select(*[c for c in df.columns if c not in gone])
