"""The batch flow of the notebooks, end to end, as one lazy plan per output.

Two front ends feed the same operators:

* ``from_files`` — the real inputs: two wide TSVs and their XML structure
  files (births: ``indicator,geo`` keys; education: six-part keys).
* ``from_orders`` — the same-shaped tables derived from the driver's order
  tables (see ``plans.cube``).

Nothing is collected; the only actions are the writes in ``publish_all``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widestat.functions.labels import ATTAINMENT_LABELS, REGION_LABEL_PAIRS
from widestat.operators.clean import clean_measures
from widestat.operators.facts import join_facts
from widestat.operators.keys import restrict, split_key
from widestat.operators.reshape import stratum_crosstab, wide_to_long
from widestat.operators.translate import relabel, relabel_age, shorten, translate
from widestat.plans import cube
from widestat.session import drop_scratch, persisted, scratch_path
from widestat.sources.codelist import load_codes
from widestat.sources.published import publish
from widestat.sources.wide import read_wide
from widestat.streaming.feed import write_stream_feed

# Fixed values of the notebooks' real inputs.
BIRTHS_YEARS = tuple(range(2009, 2021))
EDUCATION_YEARS = tuple(range(2004, 2021))
BIRTHS_INDICATOR = "GBIRTHRT_THSP"
EDUCATION_KEY_NAMES = ("Unit", "Sex", "ISCED11", "Citizen", "Age", "Country")
EDUCATION_STRATA = {
    "global": ("18-74",),
    "young": ("18-24", "25-34"),
    "middle": ("25-54",),
    "old": ("55-74",),
}
ATTAINMENT_VALUES = ("Secondary", "Tertiary", "Vocational")


@dataclass(frozen=True)
class Shape:
    """What differs between one pair of input files and another."""

    births_years: tuple[int, ...] = BIRTHS_YEARS
    education_years: tuple[int, ...] = EDUCATION_YEARS
    indicator: str = BIRTHS_INDICATOR
    key_names: tuple[str, ...] = EDUCATION_KEY_NAMES
    fixed: tuple[tuple[str, str], ...] = (("Citizen", "Total"),)
    sum_over: tuple[str, ...] = ("Unit", "Sex")
    attainment_labels: tuple[tuple[str, str], ...] = tuple(ATTAINMENT_LABELS.items())
    attainment_values: tuple[str, ...] = ATTAINMENT_VALUES


#: The order table as files: a four-part key, all four parts translated.
ORDER_SHAPE = Shape(cube.YEARS, cube.YEARS, cube.BIRTHS_INDICATOR, cube.EDU_KEY_NAMES, sum_over=(),
                    attainment_labels=(("Finished", "Secondary"), ("Open", "Tertiary"), ("Pending", "Vocational")))
STRATUM_OUTPUT = {"global": "global", "young": "young", "middle": "middle-age", "old": "old"}


class Outputs:
    """Results of one run: births long, the education long table and the
    stratum cross-tab (all strata, keyed by ``stratum``).

    Each may be given as a DataFrame or as a zero-argument builder; a builder
    runs on first use, so a query that needs only the births table never
    plans the education side.
    """

    def __init__(self, natality, education, crosstab, strata: Sequence[str] = tuple(EDUCATION_STRATA)):
        self._parts = {"natality": natality, "education": education, "crosstab": crosstab}
        self.strata = tuple(strata)

    def _get(self, name: str) -> DataFrame:
        part = self._parts[name]
        if callable(part):
            part = self._parts[name] = part()
        return part

    @property
    def natality(self) -> DataFrame:
        return self._get("natality")

    @property
    def education(self) -> DataFrame:
        return self._get("education")

    @property
    def crosstab(self) -> DataFrame:
        return self._get("crosstab")

    def education_stratum(self, name: str) -> DataFrame:
        return self.crosstab.filter(F.col("stratum") == name).drop("stratum")

    def joined(self, name: str) -> DataFrame:
        return join_facts(self.natality, self.education_stratum(name), ["Country", "Year"])

    def datasets(self) -> dict[str, DataFrame]:
        out = {"natality": self.natality}
        for s in self.strata:
            label = STRATUM_OUTPUT.get(s, s)
            out[f"joined-{label}"] = self.joined(s)
            out[f"education-{label}"] = self.education_stratum(s)
        return out


def natality_long(wide: DataFrame, codes: DataFrame, years: Sequence[int], indicator: str,
                  code_list: str | None = None, label_pairs=REGION_LABEL_PAIRS,
                  missing: str = "zero", unique_codes: bool = False) -> DataFrame:
    """Births wide table -> ``(Country, Year, Births)``."""
    clean = clean_measures(wide, years, kind="long", missing=missing, drop_keys=[indicator])
    named = translate(clean, {"key": code_list}, codes, prefix=indicator, unique_codes=unique_codes)
    named = shorten(named.withColumnRenamed("key", "Country"), "Country", label_pairs)
    return wide_to_long(named, ["Country"], years, "Year", "Births")


def education_long(wide: DataFrame, codes: DataFrame, years: Sequence[int],
                   key_names: Sequence[str], lists: Mapping[str, str | None],
                   fixed: Mapping[str, str], sum_over: Sequence[str] = (),
                   label_pairs=REGION_LABEL_PAIRS, attainment_col: str = "Education_Attainment",
                   attainment_labels: Mapping[str, str] | None = None, age_col: str = "Age",
                   age_bands: bool = False, missing: str = "zero",
                   unique_codes: bool = False) -> DataFrame:
    """Education wide table -> ``(<dims>, Year, Proportion)``."""
    clean = clean_measures(wide, years, kind="double", missing=missing)
    split = split_key(clean, "key", key_names)
    named = translate(split, lists, codes, unique_codes=unique_codes)
    cut = restrict(named, fixed, sum_over=sum_over)
    if "ISCED11" in cut.columns:
        cut = cut.withColumnRenamed("ISCED11", attainment_col)
    cut = shorten(cut, "Country", label_pairs)
    if attainment_labels:
        cut = relabel(cut, attainment_col, attainment_labels)
    if age_bands:
        cut = relabel_age(cut, age_col)
    ids = [c for c in cut.columns if c not in {str(y) for y in years}]
    return wide_to_long(cut, ids, years, "Year", "Proportion")


def from_orders(spark: SparkSession, sf_dir: str, missing: str = "zero") -> Outputs:
    """The whole flow on the order-table analog."""
    memo: dict[str, DataFrame] = {}

    def once(name, build):
        def get() -> DataFrame:
            if name not in memo:
                memo[name] = build()
            return memo[name]
        return get

    # One scan/count/join of the orders feeds both wide tables.  Nation and
    # region codes are primary keys, so the keyed lookups need no dedup step.
    counts = once("counts", lambda: cube.order_counts(spark, sf_dir))
    codes = once("codes", lambda: cube.nation_codes(spark, sf_dir))
    natality = once("natality", lambda: natality_long(
        cube.births_wide(spark, sf_dir, counts()), codes(), cube.YEARS, cube.BIRTHS_INDICATOR,
        code_list=cube.GEO_LIST, label_pairs=(), missing=missing, unique_codes=True))
    education = once("education", lambda: education_long(
        cube.orders_wide(spark, sf_dir, counts()), codes(), cube.YEARS, cube.EDU_KEY_NAMES,
        {"Country": cube.GEO_LIST}, {"Citizen": cube.CITIZEN_TOTAL}, label_pairs=(), missing=missing,
        unique_codes=True))
    crosstab = once("crosstab", lambda: stratum_crosstab(
        education(), cube.STRATA, "Age", ["Country", "Year"], "Education_Attainment",
        cube.ATTAINMENT_VALUES, "Proportion", unlisted="fail"))
    return Outputs(natality, education, crosstab, tuple(cube.STRATA))


def from_files(spark: SparkSession, births_tsv: str, births_dsd: str, education_tsv: str,
               education_dsd: str, lang: str = "en", missing: str = "zero",
               education_lists: Mapping[str, str | None] | None = None,
               sum_over: Sequence[str] | None = None,
               births_years: Sequence[int] | None = None,
               education_years: Sequence[int] | None = None, shape: Shape = Shape()) -> Outputs:
    """The whole flow on files.

    education_lists: code list per dimension (``None`` = look the code up in
        every list, the notebooks' flattened behaviour).
    sum_over: dimensions dropped without fixing a value (the notebooks drop
        unit and sex and let the cross-tab add across them).
    births_years / education_years: the year columns of each file (newer
        releases of the tables carry more years).
    shape: the files' key, years and labels; the real inputs' by default.
    """
    b_years, e_years = tuple(births_years or shape.births_years), tuple(education_years or shape.education_years)
    natality = natality_long(read_wide(spark, births_tsv, b_years), load_codes(spark, births_dsd, lang),
                             b_years, shape.indicator, missing=missing)
    lists = education_lists or {c: None for c in shape.key_names}
    education = education_long(
        read_wide(spark, education_tsv, e_years), load_codes(spark, education_dsd, lang), e_years,
        shape.key_names, lists, dict(shape.fixed), sum_over=shape.sum_over if sum_over is None else sum_over,
        attainment_labels=dict(shape.attainment_labels), age_bands=True, missing=missing)
    crosstab = stratum_crosstab(education, EDUCATION_STRATA, "Age", ["Country", "Year"],
                                "Education_Attainment", shape.attainment_values, "Proportion", unlisted="fail")
    return Outputs(natality, education, crosstab)


def settle(out: Outputs) -> Outputs:
    """Write the reused intermediates (births long, education long, all-strata
    cross-tab) as Parquet under the shared checkpoint folder and continue from
    those tables: the nine outputs and the feed then read them instead of
    recomputing the unpivot and aggregation, and a lost executor costs a
    re-read, not the whole lineage.  ``drop_settled`` deletes them."""
    spark = out.natality.sparkSession
    base = scratch_path(spark, "settled")
    out.natality.write.parquet(f"{base}/natality")
    with persisted(out.education):  # the cross-tab is made of it
        out.education.write.parquet(f"{base}/education")
        out.crosstab.write.partitionBy("stratum").parquet(f"{base}/crosstab")
    parts = {"natality": out.natality, "education": out.education, "crosstab": out.crosstab}
    settled = Outputs(*(spark.read.schema(df.schema).parquet(f"{base}/{p}") for p, df in parts.items()), out.strata)
    settled.scratch = base
    return settled


def drop_settled(settled: Outputs) -> None:
    drop_scratch(settled.natality.sparkSession, settled.scratch)


def publish_all(out: Outputs, base: str, fmt: str = "csv", feed: bool = True,
                parquet_base: str | None = None) -> dict[str, str]:
    """Write the nine datasets and the stream feed (the only actions besides
    ``settle``).

    parquet_base: also write the nine datasets as Parquet there, so readers
        get column pruning and filter pushdown (``analysis(fmt="parquet")``).
    """
    settled = settle(out)
    paths = publish(settled.datasets(), base, fmt)
    if parquet_base:
        publish(settled.datasets(), parquet_base, "parquet")
    if feed:
        paths["stream"] = write_stream_feed(settled.education, f"{base.rstrip('/')}/stream", "Year")
    drop_settled(settled)
    return paths


# Declared schemas of the published datasets (no inference pass on read).
NATALITY_SCHEMA = "Country string, Year int, Births bigint"
EDUCATION_CT_SCHEMA = "Country string, Year int, Secondary double, Tertiary double, Vocational double"
JOINED_CT_SCHEMA = ("Country string, Year int, Births bigint, Secondary double, Tertiary double, "
                    "Vocational double")
FEED_DATA_SCHEMA = "Education_Attainment string, Age string, Country string, Proportion double"


def read_analysis_inputs(spark: SparkSession, base: str, stratum: str = "global",
                         fmt: str = "csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three published datasets the analysis slices read: births, one
    education cross-tab and the matching joined table."""
    from widestat.sources.published import read_published

    label = STRATUM_OUTPUT.get(stratum, stratum)
    root = base.rstrip("/")
    return (read_published(spark, f"{root}/natality", NATALITY_SCHEMA, fmt),
            read_published(spark, f"{root}/education-{label}", EDUCATION_CT_SCHEMA, fmt),
            read_published(spark, f"{root}/joined-{label}", JOINED_CT_SCHEMA, fmt))


def analysis(spark: SparkSession, base: str, params=None, fmt: str = "csv") -> dict[str, DataFrame]:
    """N1-N13 over the published datasets under ``base``."""
    from widestat.operators.slices import SliceParams, slices

    births, education, joined = read_analysis_inputs(spark, base, "global", fmt)
    return slices(births, education, joined, params or SliceParams())


def stream_maxima(spark: SparkSession, feed_path: str, name: str = "counts", width: str = "5 weeks",
                  after_year: int | None = 2004, files_per_trigger: int | None = 1,
                  watermark: str | None = None) -> DataFrame:
    """The streaming flow: replay the education feed, keep events after
    ``after_year``, take the maximum proportion per country and ``width``
    window, and return ``SELECT * FROM <name>``.

    The feed is read with its real column order (the notebook's declared
    schema moved values between columns, F1)."""
    from pyspark.sql import types as T

    from widestat.streaming.feed import feed_schema
    from widestat.streaming.runner import read_file_stream, run_stream
    from widestat.streaming.windowed import windowed_max

    data = T._parse_datatype_string(FEED_DATA_SCHEMA)
    stream = read_file_stream(spark, feed_path, feed_schema(data, "Year"), files_per_trigger)
    agg = windowed_max(stream, ["Country"], "Year", "Proportion", width, min_year=after_year,
                       watermark=watermark)
    return run_stream(agg, name, "append" if watermark else "complete")
