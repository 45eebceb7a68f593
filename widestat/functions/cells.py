"""Column expressions for dirty statistical cells.

Published cells carry a value, an optional flag letter and ``:`` for a
missing value (``12345 b``, ``: u``, ``10.2 e``).  These expressions stay
inside whole-stage codegen: regex replace and ``try_cast`` only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from widestat.functions.sql import ident, literal

# The cleaning patterns of the source notebooks.
MISSING_MARKER = ":"
INT_DROP_PATTERN = r"[^0-9]"
INT_DROP_PATTERN_SIGNED = r"[^0-9-]"
DOUBLE_DROP_PATTERN = r"[^0-9\s.]+|\.(?!\d)"

_TYPES = {"int": "int", "long": "bigint", "double": "double"}


def clean_cell(c: Column | str, kind: str = "int", missing: str = "zero",
               keep_sign: bool = False) -> Column:
    """Turn one flagged text cell into a number.

    kind:    ``int``/``long`` keep digits only (``10.2`` -> 102, as published
             notebooks did); ``double`` keeps digits, blanks and dots that
             precede a digit.
    missing: ``zero`` turns every ``:`` into ``0`` (parity); ``null`` makes
             any cell holding ``:`` null.
    Text that leaves no number behind is null (``try_cast``), never an error.
    """
    _check(kind, missing)
    if isinstance(c, str):
        return F.expr(clean_cell_sql(c, kind, missing, keep_sign))
    col = c
    text = F.regexp_replace(col, MISSING_MARKER, "0") if missing == "zero" else col
    if kind == "double":
        kept = F.regexp_replace(text, DOUBLE_DROP_PATTERN, "")
    else:
        kept = F.regexp_replace(text, INT_DROP_PATTERN_SIGNED if keep_sign else INT_DROP_PATTERN, "")
    value = kept.try_cast(_TYPES[kind])
    if missing == "null":
        value = F.when(col.contains(MISSING_MARKER), F.lit(None).cast(_TYPES[kind])).otherwise(value)
    return value


def _check(kind: str, missing: str) -> None:
    if kind not in _TYPES:
        raise ValueError(f"kind must be one of {sorted(_TYPES)}")
    if missing not in ("zero", "null"):
        raise ValueError("missing must be 'zero' or 'null'")


def clean_cell_sql(name: str, kind: str = "int", missing: str = "zero", keep_sign: bool = False) -> str:
    """``clean_cell`` for a named column, as one SQL expression string."""
    _check(kind, missing)
    col = ident(name)
    text = f"regexp_replace({col}, {literal(MISSING_MARKER)}, '0')" if missing == "zero" else col
    if kind == "double":
        pattern = DOUBLE_DROP_PATTERN
    else:
        pattern = INT_DROP_PATTERN_SIGNED if keep_sign else INT_DROP_PATTERN
    value = f"try_cast(regexp_replace({text}, {literal(pattern)}, '') AS {_TYPES[kind]})"
    if missing == "null":
        value = f"CASE WHEN contains({col}, {literal(MISSING_MARKER)}) THEN NULL ELSE {value} END"
    return value
