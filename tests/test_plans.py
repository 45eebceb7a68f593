"""Plan guard: no registered query may plan a single-partition exchange, a
cartesian or nested-loop join, or a window without a partition key."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from plan_audit import FLAGS  # noqa: E402
from widestat.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan_has_no_unscalable_shape(spark, name):
    df = E.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns), df.columns  # the driver sorts columns by name
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [k for k, rx in FLAGS.items() if rx.search(plan)]
    assert not found, found


def test_scans_prune_columns(spark):
    # a two-column question reads two columns
    df = E.queries()["windowed_max_batch"](spark, SF)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_guard_flags_bad_shapes(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(100)
    single = df.withColumn("rn", F.row_number().over(Window.orderBy(F.lit(1))))
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert FLAGS["single partition exchange"].search(plan)
    assert FLAGS["window without partition"].search(plan)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cross = df.crossJoin(spark.range(3))
        plan = cross._jdf.queryExecution().executedPlan().toString()
        assert FLAGS["cartesian product"].search(plan) or FLAGS["nested loop join"].search(plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_guard_passes_partitioned_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(100)
    part = df.withColumn("rn", F.row_number().over(Window.partitionBy(F.col("id") % 3).orderBy("id")))
    assert not FLAGS["window without partition"].search(part._jdf.queryExecution().executedPlan().toString())


def test_crosstab_discovered_has_a_column_for_every_nation(spark, tmp_path):
    """A nation without suppliers or lines is a column of nulls, as in the SQL."""
    for name, rows, schema in (
            ("lineitem", [(1, "A", 2.0), (1, "A", 3.0), (2, "R", 5.0)], "l_suppkey long, l_returnflag string, l_quantity double"),
            ("supplier", [(1, 0), (2, 0), (3, 1)], "s_suppkey long, s_nationkey long"),
            ("nation", [(0, "NATION_0"), (1, "NATION_1"), (2, "NATION_2")], "n_nationkey long, n_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = catalog.queries()["crosstab_discovered"](spark, str(tmp_path))
    assert out.columns == ["l_returnflag", "NATION_0", "NATION_1", "NATION_2"]
    assert sorted(map(tuple, out.collect())) == [("A", 5.0, None, None), ("R", 5.0, None, None)]
