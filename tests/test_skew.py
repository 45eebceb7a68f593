"""One key holding a third of all rows: results stay exact and the hot key is
folded before any exchange."""

import os
import shutil
import sys

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_key  # noqa: E402
from widestat.plans import cube  # noqa: E402

SRC = "/root/testdata/sf0.001"
HOT = 7


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("skewed"))
    for name in ("customer", "nation", "region", "part"):
        shutil.copy(f"{SRC}/{name}.parquet", f"{d}/{name}.parquet")
    orders = pq.read_table(f"{SRC}/orders.parquet")
    n = orders.num_rows
    hot = pa.array([i % 3 == 0 for i in range(n)])
    cust = pc.if_else(hot, pa.scalar(HOT, pa.int64()), orders.column("o_custkey"))
    orders = orders.set_column(orders.schema.get_field_index("o_custkey"), "o_custkey", cust)
    pq.write_table(orders, f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["join_facts_global", "crosstab_young", "translate_customer_names",
                                  "domain_profile", "windowed_max_batch", "trend", "split_key_pivot_form"])
def test_hot_customer_matches_oracle(spark, skewed, name):
    df = E.queries()[name](spark, skewed)
    cur = duck(skewed).execute(E.oracle_sql()[name])
    d_cols, d_rows = [c[0] for c in cur.description], cur.fetchall()
    s_rows = [tuple(r) for r in df.collect()]
    assert rows_key(df.columns, s_rows) == rows_key(d_cols, d_rows)


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
#: Thresholds small enough for the fixture's few kilobytes.
SPLIT = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
         "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def conf(spark):
    changed = []

    def put(values):
        for k, v in values.items():
            spark.conf.set(k, v)
            changed.append(k)
    yield put
    for k in changed:
        spark.conf.unset(k)


def test_orders_are_shuffled_once(spark, skewed, conf):
    conf(NO_BROADCAST)
    df = E.queries()["join_facts_global"](spark, skewed)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "Scan parquet" in line and "o_custkey" in line]
    assert len(scans) == 1, final
    assert "ReusedExchange" in final


def test_hot_customer_is_split(spark, skewed, conf, tmp_path):
    conf(NO_BROADCAST | SPLIT)
    shutil.copy(f"{skewed}/customer.parquet", tmp_path / "customer.parquet")
    orders = pq.read_table(f"{skewed}/orders.parquet")
    (tmp_path / "orders.parquet").mkdir()
    for i in range(10):  # a partition is split between the tasks that wrote to it
        pq.write_table(orders.slice(i * 150, 150), tmp_path / "orders.parquet" / f"part-{i}.parquet")
    counts = cube.order_counts(spark, str(tmp_path))
    total = sum(r.n for r in counts.collect())
    final = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "skew=true" in final
    assert total == orders.num_rows


def test_a_year_without_a_column_is_an_error(spark, skewed, tmp_path):
    import datetime as dt

    for name in ("customer", "orders"):
        shutil.copy(f"{skewed}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = pq.read_table(f"{skewed}/orders.parquet")
    at = orders.schema.get_field_index("o_orderdate")
    days = orders.column("o_orderdate").to_pylist()
    late = orders.set_column(at, orders.schema.field(at), pa.array([dt.datetime(2031, 5, 1)] + days[1:], orders.schema.field(at).type))
    pq.write_table(late, tmp_path / "orders.parquet")
    with pytest.raises(Exception, match="2031"):
        cube.orders_wide(spark, str(tmp_path)).collect()
