"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line.  Each query is built and run to completion into the
``noop`` sink (no rows to the driver), three times; the fastest run is reported.
Build time is included: source/sink and stream queries do their writes there.

The orders counted into the wide table are the larger part of most of these;
`split_key_written` and `translate_written` (outside the total) time the
operators alone, over a wide table written beforehand.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from widestat.operators.keys import split_key  # noqa: E402
from widestat.operators.translate import translate  # noqa: E402
from widestat.plans import catalog, cube  # noqa: E402
from widestat.session import get_spark, scratch_path  # noqa: E402

HEADLINE = [
    "join_facts_global",
    "lineitem_crosstab",
    "crosstab_young",
    "natality_long",
    "education_long",
    "wide_tsv_scan",
    "clean_double",
    "split_key",
    "translate_codes",
    "translate_prefixed",
    "translate_customer_names",
    "codelist_xml",
    "domain_profile",
    "wide_to_long",
    "slice_n10",
    "trend",
    "co_movement",
    "windowed_max_batch",
    "windowed_max_stream",
    "windowed_max_watermark",
    "stream_sql",
    "csv_roundtrip",
    "partitioned_feed_scan",
]


ERRORS: dict[str, str] = {}


def run(build, spark, sf, repeats=3, name=None):
    """Best wall time of ``repeats`` runs; None (and an entry in ERRORS) if the
    query fails, so one failure does not lose the other timings."""
    best = None
    try:
        for _ in range(repeats):
            t0 = time.perf_counter()
            build(spark, sf).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
    except Exception as e:  # noqa: BLE001
        ERRORS[name or getattr(build, "__name__", "?")] = f"{type(e).__name__}: {str(e)[:200]}"
        return None
    return round(best, 3)


def _sf_value(sf_dir):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                      **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = catalog.queries()
    run(qs["windowed_max_batch"], spark, sf, repeats=1)  # JVM warm-up
    times = {name: run(qs[name], spark, sf, name=name) for name in HEADLINE}
    path = scratch_path(spark, "bench-wide")
    cube.orders_wide(spark, sf).write.parquet(path)

    def split_written(spark, sf):
        return split_key(spark.read.parquet(path), "key", cube.EDU_KEY_NAMES)

    def translate_written(spark, sf):
        return translate(split_written(spark, sf), {"Country": cube.GEO_LIST}, cube.nation_codes(spark, sf), unique_codes=True)

    alone = {"split_key_written": run(split_written, spark, sf), "translate_written": run(translate_written, spark, sf)}
    total = round(sum(v for v in times.values() if v is not None), 3)

    result = {
        "metric": "headline_total_wall",
        "value": total,
        "unit": "sec",
        "queries": times,
        "operators_alone": alone,
        "sf": _sf_value(sf),
        "cpus": cpus,
        "spark": spark.version,
    }
    if ERRORS:
        result["errors"] = ERRORS
    spark.stop()  # state-store shutdown may log on stderr: print the result last
    sys.stderr.flush()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
