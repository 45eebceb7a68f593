import pytest
from pyspark.sql import functions as F

from conftest import rows

from widestat.functions.cells import clean_cell
from widestat.operators.clean import clean_measures

# FIXTURES.md §3: cell -> (int parity, double parity)
CASES = [
    ("12345 b", 12345, 12345.0),
    (":", 0, 0.0),
    (": ", 0, 0.0),
    (": u", 0, 0.0),
    (":c", 0, 0.0),
    ("10.2 e", 102, 10.2),
    ("-7 ", 7, 7.0),
    ("abc", None, None),
    ("", None, None),
    ("12.3bu", 123, 12.3),
    ("0.", 0, 0.0),
    ("(12.0)", 120, 12.0),
    ("1.2.3", 123, None),
    ("1 2", 12, None),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CASES)], "i int, c string")


def test_int_parity(cells):
    got = {r.i: r.v for r in cells.select("i", clean_cell("c", "int").alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_double_parity(cells):
    got = {r.i: r.v for r in cells.select("i", clean_cell("c", "double").alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_missing_null_mode(cells):
    got = {r.i: r.v for r in cells.select("i", clean_cell("c", "double", missing="null").alias("v")).collect()}
    for i, (c, _, d) in enumerate(CASES):
        assert got[i] == (None if ":" in c else d)


def test_keep_sign(spark):
    df = spark.createDataFrame([("-7 ",), ("12 b",)], "c string")
    assert [r.v for r in df.select(clean_cell("c", "int", keep_sign=True).alias("v")).collect()] == [-7, 12]


def test_null_cell_and_ansi_safe(spark):
    # under ANSI a plain cast of '' or 'abc' throws; try_cast gives null.
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([(None,), ("abc",), ("",)], "c string")
    assert [r.v for r in df.select(clean_cell("c", "int").alias("v")).collect()] == [None, None, None]


def test_clean_measures_drop_keys(spark):
    # the exact bare indicator row goes, prefixed rows stay; a null key
    # goes with it (the notebook's =!= is null there) and stays otherwise.
    df = spark.createDataFrame([("GBIRTHRT_THSP", "1"), ("GBIRTHRT_THSP,AT", "2 b"), (None, ":")],
                               "key string, `2009` string")
    out = clean_measures(df, [2009], drop_keys=["GBIRTHRT_THSP"])
    assert [tuple(r) for r in out.collect()] == [("GBIRTHRT_THSP,AT", 2)]
    assert clean_measures(df, [2009]).count() == 3
    assert dict(out.dtypes)["2009"] == "int"


def test_bad_kind(spark):
    with pytest.raises(ValueError):
        clean_cell(F.col("c"), "text")


def test_preview_reads_raw_lines(spark, tmp_path):
    from widestat.sources.wide import preview
    p = tmp_path / "w.tsv"
    p.write_text("indic_de,geo\\time\t2009\nGBIRTHRT_THSP,AT\t9.4 \nGBIRTHRT_THSP,BE\t: \n")
    assert [r.value for r in preview(spark, str(p), 2).collect()] == ["indic_de,geo\\time\t2009", "GBIRTHRT_THSP,AT\t9.4 "]


def test_read_wide_binds_by_position(spark, tmp_path):
    from widestat.sources.wide import read_wide
    p = tmp_path / "w.tsv"
    p.write_text("indic_de,geo\\time\t2009\t2010\nGBIRTHRT_THSP,AT\t9.4 \t: \nGBIRTHRT_THSP,BE\t\t10 b\n")
    df = read_wide(spark, str(p), [2009, 2010])
    assert df.columns == ["key", "2009", "2010"]
    assert sorted(df.collect(), key=repr) == sorted([("GBIRTHRT_THSP,AT", "9.4 ", ": "), ("GBIRTHRT_THSP,BE", None, "10 b")], key=repr)


def test_lost_cells_are_counted_in_the_pass(spark, workdir):
    from pyspark.sql import Observation

    from widestat.operators.clean import clean_measures, lost_cells

    cells = ["1.2.3", "1 2", "n/a", ": u", None, "", "12.5 b", "7"]
    df = spark.createDataFrame([(f"k{i}", c, "1") for i, c in enumerate(cells)] + [("IND", "x", "y")], "key string, `2001` string, `2002` string")
    seen = Observation()
    clean = clean_measures(df, [2001, 2002], kind="double", missing="null", drop_keys=["IND"], observation=seen)
    assert clean.columns == df.columns
    clean.write.parquet(f"{workdir}/clean")
    assert rows(lost_cells(spark, seen)) == sorted([("2001", "empty", 1), ("2001", "missing", 1), ("2001", "no digits", 2), ("2001", "not one number", 2)])
    plain = clean_measures(df, [2001, 2002], kind="double", missing="null", drop_keys=["IND"])
    assert rows(spark.read.parquet(f"{workdir}/clean")) == rows(plain)
    # every null of the result has a reason
    assert plain.where("`2001` is null").count() == 6
    digits = Observation()
    clean_measures(df, [2001], kind="int", observation=digits).collect()
    assert rows(lost_cells(spark, digits)) == [("2001", "empty", 1), ("2001", "missing", 1), ("2001", "no digits", 3)]
    none = Observation()
    clean_measures(df.limit(0), [2001, 2002], observation=none).collect()
    assert lost_cells(spark, none).count() == 0
