"""C12 fact join on shared dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_facts(left: DataFrame, right: DataFrame, on: Sequence[str] = ("Country", "Year"),
               how: str = "inner") -> DataFrame:
    """USING join on ``on``.  Both sides are one row per key at this grain, so
    no key is hot; Catalyst/AQE choose sort-merge or broadcast from sizes."""
    return left.join(right, list(on), how)
