import pytest
from pyspark.sql import functions as F

from conftest import rows
from widestat.operators.keys import restrict, split_key, split_key_pivot_form
from widestat.operators.rowid import with_row_id

NAMES = ["a", "b", "c"]


def test_ragged_keys_give_nulls(spark):
    df = spark.createDataFrame([("A,B,C", "1"), ("A,B", "2"), ("A", "3")], "key string, v string")
    assert rows(split_key(df, "key", NAMES)) == sorted(
        [("A", "B", "C", "1"), ("A", "B", None, "2"), ("A", None, None, "3")], key=repr)


def test_split_key_is_one_projection(spark):
    df = spark.createDataFrame([("A,B,C", "1")], "key string, v string")
    plan = split_key(df, "key", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_pivot_form_equals_split_after_shuffle(spark):
    # a source behind a shuffle, >= 1,000 distinct keys.  The id is a
    # function of the key, so codes stay with their own measures.
    base = spark.range(1500).select(
        F.concat_ws(",", (F.col("id") % 7).cast("string"), (F.col("id") % 11).cast("string"),
                    F.col("id").cast("string")).alias("key"),
        F.col("id").cast("string").alias("v"))
    shuffled = base.repartition(13).groupBy("key").agg(F.first("v").alias("v"))
    fast = split_key(shuffled, "key", NAMES)
    slow = split_key_pivot_form(shuffled, "key", NAMES)
    assert rows(fast) == rows(slow)
    assert all(r.c == r.v for r in slow.collect())


def test_row_id_dense_and_unique(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).repartition(9)
    out = with_row_id(df, ["k"])
    first = {r.k: r.row_id for r in out.collect()}
    assert [first[k] for k in sorted(first)] == list(range(1, 2001))  # in order, over all partitions
    assert {r.k: r.row_id for r in out.repartition(3).collect()} == first  # fixed once written
    sparse = with_row_id(df, ["k"], dense=False)
    ids = {r.k: r.row_id for r in sparse.collect()}
    assert sorted(ids, key=ids.get) == sorted(first) and len(set(ids.values())) == 2000
    assert with_row_id(df.limit(0), ["k"]).count() == 0

def test_restrict_requires_fixed_or_sum_over(spark):
    # dropping sex without fixing it would sum F and M together.
    df = spark.createDataFrame([("F", "Total", 1.0), ("M", "Total", 2.0)], "Sex string, Citizen string, v double")
    with pytest.raises(ValueError):
        restrict(df, {"Citizen": "Total"}, drop=["Sex"])
    assert rows(restrict(df, {"Citizen": "Total", "Sex": "F"})) == [(1.0,)]
    assert restrict(df, {"Citizen": "Total"}, sum_over=["Sex"]).columns == ["v"]


def test_persisted_scope(spark):
    from widestat.session import persisted
    df = spark.range(100)
    with persisted(df) as d:
        assert d.is_cached and d.count() == 100
    assert not df.is_cached


def test_row_id_cuts_a_heavy_tie(spark):
    """One value in most of the rows: several writers, numbers dense and each value's consecutive."""
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_row_id(df, ["k"])
        places = with_row_id(df, ["k"], dense=False)
        writers = places.where("k = 'hot'").select(F.shiftright("row_id", 33)).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert writers >= 4
    spans = out.groupBy("k").agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).orderBy(F.min("row_id")).collect()
    at = 0
    for k, first, last, n in spans:
        assert first == at + 1 and last - first + 1 == n
        at = last
    assert at == 30_000 and [r[0] for r in spans] == sorted(r[0] for r in spans)
