"""Wide TSVs + XML structure files -> nine published datasets + stream feed
-> read back -> the thirteen analysis slices."""

import os

import pytest
from pyspark.sql import functions as F

from widestat.operators.slices import SliceParams, slices
from widestat.plans import etl
from pyspark.sql import types as T

from widestat.sources.published import read_feed, read_published
from widestat.streaming.feed import feed_schema
from widestat.streaming.windowed import windowed_max

GEO = {
    "AT": "Austria",
    "IS": "Iceland",
    "EU28": "European Union - 28 countries (2013-2020)",
    "EA19": "Euro area - 19 countries  (from 2015)",
    "EU27_2007": "European Union - 27 countries (2007-2013)",
}
ISCED = {
    "ED0-2": "Less than primary, primary and lower secondary education (levels 0-2)",
    "ED3-8": "Upper secondary, post-secondary non-tertiary and tertiary education (levels 3-8)",
    "ED3_4": "Upper secondary and post-secondary non-tertiary education (levels 3 and 4)",
}
AGES = {"Y18-74": "From 18 to 74 years", "Y18-24": "From 18 to 24 years", "Y25-34": "From 25 to 34 years",
        "Y25-54": "From 25 to 54 years", "Y55-74": "From 55 to 74 years"}
LISTS = {"CL_UNIT": {"PC": "Percentage"}, "CL_SEX": {"F": "Females"}, "CL_ISCED11": ISCED,
         "CL_CITIZEN": {"TOTAL": "Total", "NAT": "Reporting country"}, "CL_AGE": AGES, "CL_GEO": GEO}


def dsd(lists):
    body = []
    for name, codes in lists.items():
        body.append(f'<structure:CodeList id="{name}">')
        for code, text in codes.items():
            body.append(f'<structure:Code value="{code}"><structure:Description xml:lang="en">{text}'
                        f'</structure:Description></structure:Code>')
        body.append("</structure:CodeList>")
    return ('<?xml version="1.0"?><mes:Structure xmlns:mes="m" xmlns:structure="s">'
            f'<mes:CodeLists>{"".join(body)}</mes:CodeLists></mes:Structure>')


def births_value(geo, year):
    return 100 + len(geo) * 10 - (year - 2009) + (5 if geo == "IS" and year > 2018 else 0)


def edu_value(isced, age, geo, year):
    return round(10 + list(ISCED).index(isced) * 5 + list(AGES).index(age) + len(geo) * 0.1 + (year - 2004) * 0.5, 1)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("inputs"))
    with open(os.path.join(d, "births.tsv"), "w") as f:
        f.write("indic_de,geo\\time\t" + "\t".join(str(y) for y in range(2009, 2021)) + "\n")
        f.write("GBIRTHRT_THSP\t" + "\t".join(": " for _ in range(2009, 2021)) + "\n")
        for geo in GEO:
            cells = [f"{births_value(geo, y)}" + (" p" if y == 2020 else "") for y in range(2009, 2021)]
            f.write(f"GBIRTHRT_THSP,{geo}\t" + "\t".join(cells) + "\n")
    with open(os.path.join(d, "education.tsv"), "w") as f:
        f.write("unit,sex,isced11,citizen,age,geo\\time\t" + "\t".join(str(y) for y in range(2004, 2021)) + "\n")
        for isced in ISCED:
            for age in AGES:
                for geo in GEO:
                    for cit in ("TOTAL", "NAT"):
                        cells = [(": u" if (y == 2004 and geo == "EU28") else f"{edu_value(isced, age, geo, y)} b")
                                 for y in range(2004, 2021)]
                        f.write(f"PC,F,{isced},{cit},{age},{geo}\t" + "\t".join(cells) + "\n")
    for name, lists in (("births_dsd", {"CL_GEO": GEO}), ("education_dsd", LISTS)):
        os.makedirs(os.path.join(d, name))
        with open(os.path.join(d, name, "dsd.xml"), "w") as f:
            f.write(dsd(lists))
    return d


@pytest.fixture(scope="module")
def outputs(spark, inputs):
    return etl.from_files(spark, f"{inputs}/births.tsv", f"{inputs}/births_dsd",
                          f"{inputs}/education.tsv", f"{inputs}/education_dsd")


def test_natality(outputs):
    rows = {(r.Country, r.Year): r.Births for r in outputs.natality.collect()}
    assert len(rows) == 5 * 12
    assert rows[("Austria", 2009)] == births_value("AT", 2009)
    assert rows[("EU28", 2020)] == births_value("EU28", 2020)
    assert {c for c, _ in rows} == {"Austria", "Iceland", "EU28", "EU19", "Old_EU27"}


def test_education_long(outputs):
    edu = outputs.education
    assert sorted(edu.columns) == sorted(["Education_Attainment", "Age", "Country", "Year", "Proportion"])
    assert {r.Education_Attainment for r in edu.select("Education_Attainment").distinct().collect()} == \
        {"Secondary", "Tertiary", "Vocational"}
    assert {r.Age for r in edu.select("Age").distinct().collect()} == {"18-74", "18-24", "25-34", "25-54", "55-74"}
    assert edu.count() == 3 * 5 * 5 * 17  # citizen fixed at Total


def test_strata(outputs):
    young = {(r.Country, r.Year): r for r in outputs.education_stratum("young").collect()}
    r = young[("Austria", 2010)]
    assert r.Tertiary == pytest.approx(edu_value("ED3-8", "Y18-24", "AT", 2010) + edu_value("ED3-8", "Y25-34", "AT", 2010))
    glob = {(r.Country, r.Year): r for r in outputs.education_stratum("global").collect()}
    assert glob[("EU28", 2004)].Secondary == 0.0  # ':' counts as 0 in parity mode


def test_publish_and_slices(spark, outputs, tmp_path):
    base = str(tmp_path / "analysis")
    paths = etl.publish_all(outputs, base)
    names = {"natality", "joined-global", "joined-young", "joined-middle-age", "joined-old",
             "education-global", "education-young", "education-middle-age", "education-old", "stream"}
    assert set(paths) == names
    births = read_published(spark, paths["natality"], infer=True)
    edu = read_published(spark, paths["education-global"], infer=True)
    joined = read_published(spark, paths["joined-global"], infer=True)
    assert dict(births.dtypes)["Births"] == "int"
    s = slices(births, edu, joined, SliceParams())
    counts = {k: v.count() for k, v in s.items()}
    assert counts["n1"] == 2 * 12                      # Austria, Iceland
    assert counts["n2"] == 3 * 11                      # EU28, EU19, Old_EU27 without 2020
    assert counts["n6"] == 11 and counts["n7"] == 16   # EU28 series
    assert counts["n8"] == 0                           # no EU15 in the inputs
    assert counts["n9"] == 12                          # EU19 joined 2009-2020
    assert counts["n10"] == 2 * 16                     # EU28 and Old_EU27 (F13: Old_EU27 kept)
    assert counts["n11"] == 11                         # EU28 only
    assert counts["n12"] == 2 * 3 and counts["n13"] == 12
    feed = spark.read.option("header", True).csv(paths["stream"])
    assert feed.filter(F.year("Year") > 2004).count() == 3 * 5 * 5 * 16


def test_analysis_and_stream_entry_points(spark, outputs, tmp_path):
    base = str(tmp_path / "analysis")
    paths = etl.publish_all(outputs, base)
    s = etl.analysis(spark, base)
    assert s["n9"].count() == 12 and s["n13"].count() == 12
    assert dict(s["n1"].dtypes)["Births"] == "bigint"
    streamed = etl.stream_maxima(spark, paths["stream"], name="counts_e2e", files_per_trigger=4)
    assert spark.sql("SELECT count(*) AS n FROM counts_e2e").first().n == streamed.count()
    # batch twin: the same function over the feed read as a batch table
    schema = feed_schema(T._parse_datatype_string(etl.FEED_DATA_SCHEMA), "Year")
    batch = windowed_max(read_feed(spark, paths["stream"], schema), ["Country"], "Year", "Proportion",
                         min_year=2004)
    assert streamed.count() == 5 * 16
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_keyed_lists_and_null_missing(spark, inputs):
    keyed = {"Unit": "CL_UNIT", "Sex": "CL_SEX", "ISCED11": "CL_ISCED11", "Citizen": "CL_CITIZEN",
             "Age": "CL_AGE", "Country": "CL_GEO"}
    out = etl.from_files(spark, f"{inputs}/births.tsv", f"{inputs}/births_dsd", f"{inputs}/education.tsv",
                         f"{inputs}/education_dsd", education_lists=keyed, missing="null")
    glob = {(r.Country, r.Year): r for r in out.education_stratum("global").collect()}
    assert glob[("EU28", 2004)].Secondary is None          # ':' is missing, not 0
    assert glob[("Austria", 2010)].Secondary == pytest.approx(edu_value("ED0-2", "Y18-74", "AT", 2010))
    births = {(r.Country, r.Year): r.Births for r in out.natality.collect()}
    assert births[("Iceland", 2020)] == births_value("IS", 2020)


def test_parquet_copy_pushdown(spark, outputs, tmp_path):
    base, pq_base = str(tmp_path / "csv"), str(tmp_path / "parquet")
    etl.publish_all(outputs, base, feed=False, parquet_base=pq_base)
    from_csv = {k: v.count() for k, v in etl.analysis(spark, base).items()}
    from_pq = etl.analysis(spark, pq_base, fmt="parquet")
    assert {k: v.count() for k, v in from_pq.items()} == from_csv
    plan = from_pq["n13"]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Country), Not(StringContains(Country,EU))" in plan


def test_command_line(spark, inputs, tmp_path):
    from widestat.__main__ import main
    out = str(tmp_path / "cli")
    paths = main(["process", f"{inputs}/births.tsv", f"{inputs}/births_dsd", f"{inputs}/education.tsv",
                  f"{inputs}/education_dsd", out])
    assert "stream" in paths and len(paths) == 10
    counts = main(["analyze", out])
    assert counts["n13"] == 12 and counts["n1"] == 24
    assert main(["stream", paths["stream"], "--files-per-trigger", "8", "--name", "counts_cli"])["rows"] == 80


def test_exact_aggregate_set(spark, outputs):
    # F13 fixed: with an exact set, Old_EU27 is no longer taken for an aggregate
    from widestat.operators.slices import births_aggregate, births_national
    exact = SliceParams(aggregates=("EU28", "EU19", "EU27"))
    assert births_aggregate(outputs.natality, exact).select("Country").distinct().count() == 2
    assert "Old_EU27" in {r.Country for r in births_national(outputs.natality, exact).collect()}
    assert births_aggregate(outputs.natality, SliceParams()).select("Country").distinct().count() == 3
