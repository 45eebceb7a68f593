from pyspark.sql import functions as F

from conftest import rows
from widestat.functions.labels import REGION_LABEL_PAIRS
from widestat.operators.translate import relabel, shorten, translate

CODES = "code_list string, code string, lang string, description string"


def codes_df(spark, data):
    df = spark.createDataFrame(data, CODES)
    return df.withColumn("code_pos", F.struct(F.monotonically_increasing_id().alias("list_pos"),
                                              F.lit(0).cast("bigint").alias("pos")))


def test_code_in_two_lists(spark):
    # "T" is Total in the sex list and another thing in the geo list.
    codes = codes_df(spark, [("SEX", "T", "en", "Total"), ("GEO", "T", "en", "Tee land")])
    df = spark.createDataFrame([("T", "T")], "Sex string, Country string")
    out = translate(df, {"Sex": "SEX", "Country": "GEO"}, codes)
    assert rows(out) == [("Total", "Tee land")]


def test_flattened_last_wins(spark):
    codes = codes_df(spark, [("SEX", "T", "en", "Total"), ("GEO", "T", "en", "Tee land")])
    df = spark.createDataFrame([("T",)], "Sex string")
    assert rows(translate(df, ["Sex"], codes)) == [("Tee land",)]


def test_no_description_in_language(spark):
    # F8: keep the code by default; parity mode gives ''.
    codes = codes_df(spark, [("GEO", "XX", "en", None)])
    df = spark.createDataFrame([("XX",), ("YY",)], "Country string")
    assert rows(translate(df, {"Country": "GEO"}, codes)) == [("XX",), ("YY",)]
    assert rows(translate(df, {"Country": "GEO"}, codes, missing="empty")) == [("",), ("YY",)]


def test_description_equal_to_other_code(spark):
    # A -> B must not go on to B -> Bee.
    codes = codes_df(spark, [("L", "A", "en", "B"), ("L", "B", "en", "Bee")])
    df = spark.createDataFrame([("A",), ("B",)], "c string")
    assert rows(translate(df, {"c": "L"}, codes)) == [("B",), ("Bee",)]


def test_special_characters(spark):
    # '.' in a code and '$0' in a description are plain text.
    codes = codes_df(spark, [("L", "A.B", "en", "cost $0"), ("L", "AXB", "en", "other")])
    df = spark.createDataFrame([("A.B",), ("ACB",)], "c string")
    assert rows(translate(df, {"c": "L"}, codes)) == [("ACB",), ("cost $0",)]


def test_prefixed_keys(spark):
    # only INDICATOR,<code> is translated; the bare indicator stays.
    codes = codes_df(spark, [("GEO", "AT", "en", "Austria")])
    df = spark.createDataFrame([("GBIRTHRT_THSP,AT",), ("GBIRTHRT_THSP",), ("OTHER,AT",)], "key string")
    out = translate(df, ["key"], codes, prefix="GBIRTHRT_THSP")
    assert rows(out) == [("Austria",), ("GBIRTHRT_THSP",), ("OTHER,AT",)]


def test_row_count_kept_with_duplicate_codes(spark):
    codes = codes_df(spark, [("L", "A", "en", "first"), ("L", "A", "en", "second")])
    df = spark.range(100).select(F.lit("A").alias("c"))
    out = translate(df, {"c": "L"}, codes)
    assert out.count() == 100
    assert {r.c for r in out.collect()} == {"second"}


def test_join_form_follows_the_size(spark):
    codes = codes_df(spark, [("L", str(i), "en", f"d{i}") for i in range(50)])
    df = spark.range(1000).select((F.col("id") % 60).cast("string").alias("c"))
    out = translate(df, {"c": "L"}, codes)
    assert out.count() == 1000
    out.collect()  # decided by adaptive execution from the real size: read the final plan
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        out = translate(df, {"c": "L"}, codes)
        out.collect()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_one_join_for_many_columns(spark):
    codes = codes_df(spark, [("A", "1", "en", "one"), ("A", "2", "en", None), ("B", "1", "en", "uno"), ("B", "3", "en", "tres")])
    df = spark.createDataFrame([(10, "1", "1", "x"), (11, "2", "3", "y"), (12, None, "9", "z"), (13, "3", "1", None)],
                               "id long, a string, b string, other string")
    for missing in ("keep", "empty"):
        each = translate(df, {"a": "A", "b": "B"}, codes, missing=missing)
        once = translate(df, {"a": "A", "b": "B"}, codes, missing=missing, row_key="id")
        assert once.columns == each.columns and rows(once) == rows(each)
    assert rows(translate(df, ["a", "b"], codes, row_key="id")) == rows(translate(df, ["a", "b"], codes))


def test_every_code_by_its_own_description(spark):
    codes = codes_df(spark, [("L", "1", "en", "name 1"), ("L", "10", "en", "name 10"), ("L", "2", "en", "10")])
    df = spark.createDataFrame([("1",), ("10",), ("2",), ("11",)], "c string")
    assert rows(translate(df, {"c": "L"}, codes)) == [("10",), ("11",), ("name 1",), ("name 10",)]


def test_shorten_region_labels(spark):
    # Old_EU27 contains EU27; the order of the pairs is kept.
    df = spark.createDataFrame([(d,) for d, _ in REGION_LABEL_PAIRS] + [("Austria",)], "Country string")
    out = [r.Country for r in shorten(df, "Country", REGION_LABEL_PAIRS).collect()]
    assert out == ["Germany", "EU15", "EU18", "EU19", "Old_EU27", "EU27", "EU28", "Austria"]
    assert sum("EU27" in x for x in out) == 2


def test_relabel_is_one_form_for_every_length(spark):
    df = spark.createDataFrame([("a",), ("b",), ("n",), ("zz",), (None,)], "c string")
    want = sorted([("A",), ("B",), (None,), ("zz",), (None,)], key=repr)
    small = {"a": "A", "b": "B", "n": None}
    assert rows(relabel(df, "c", small)) == want
    assert rows(relabel(df, "c", {f"k{i}": f"v{i}" for i in range(500)} | small)) == want
    assert rows(relabel(df, "c", {})) == rows(df)


def test_unique_codes_skips_dedup(spark):
    codes = codes_df(spark, [("L", str(i), "en", f"d{i}") for i in range(20)])
    df = spark.range(100).select((F.col("id") % 25).cast("string").alias("c"))
    fast = translate(df, {"c": "L"}, codes, unique_codes=True)
    assert rows(fast) == rows(translate(df, {"c": "L"}, codes))
    assert "Aggregate" not in fast._jdf.queryExecution().executedPlan().toString()
