"""Expressions over composite code keys such as ``PC,F,ED0-2,TOTAL,Y25-34,AT``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_quote(text: str) -> str:
    """Quote a literal for a Java regex (``split`` takes a pattern)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def key_parts(c: Column | str, sep: str = ",") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.split(col, java_quote(sep))


def key_part(c: Column | str, i: int, sep: str = ",") -> Column:
    """Element ``i`` (0-based) of the split key; null when the key is short.

    ``get`` instead of ``[]``: under ANSI an out-of-range index would throw.
    """
    return F.get(key_parts(c, sep), i)


def strip_prefix(c: Column | str, prefix: str, sep: str = ",") -> Column:
    """The code after ``prefix + sep``; null when the value lacks the prefix."""
    col = F.col(c) if isinstance(c, str) else c
    head = prefix + sep
    return F.when(col.startswith(F.lit(head)), F.substr(col, F.lit(len(head) + 1)))
