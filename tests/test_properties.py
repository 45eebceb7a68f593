"""Property checks: cell cleaning against a plain-Python model of the same
rules, on random flagged cells (one Spark job per generated batch)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from widestat.functions.cells import DOUBLE_DROP_PATTERN, INT_DROP_PATTERN, clean_cell

CELL = st.text(alphabet="0123456789 .:-abepu", max_size=9)


def model_int(cell):
    digits = re.sub(INT_DROP_PATTERN, "", cell.replace(":", "0"))
    if not digits:
        return None
    value = int(digits)
    return value if value < 2 ** 31 else None


def model_double(cell):
    kept = re.sub(DOUBLE_DROP_PATTERN, "", cell.replace(":", "0")).strip()
    if not re.fullmatch(r"\d+\.?\d*|\.\d+", kept):
        return None
    return float(kept)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CELL, min_size=1, max_size=300))
def test_clean_cell_matches_model(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.select("i", clean_cell("c", "int").alias("n"), clean_cell("c", "double").alias("d")).collect()
    by_i = {r.i: (r.n, r.d) for r in got}
    for i, c in enumerate(cells):
        assert by_i[i] == (model_int(c), model_double(c)), repr(c)
