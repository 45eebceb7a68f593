"""Registered queries: one per operator of the inventory, each over the
driver's tables at ``sf_dir`` (whole tables, no sampling).

Every callable is ``(spark, sf_dir) -> DataFrame``.  Queries that cover a
source or a sink write their input under the shared checkpoint folder first
and return the lazy read-back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widestat.functions.cells import clean_cell
from widestat.operators.clean import clean_measures, domain_profile, lost_cells
from widestat.operators.keys import restrict, split_key, split_key_pivot_form
from widestat.operators.reshape import crosstab, discover_values, stratum_crosstab, wide_to_long
from widestat.operators.rowid import with_row_id
from widestat.operators.slices import SLICE_SOURCE, SliceParams, one_slice
from widestat.operators.translate import relabel, relabel_age, shorten, translate
from widestat.operators.trends import co_movement, risers, series_gap, trend
from widestat.plans import cube, etl
from widestat.session import scratch_path
from widestat.sources.codelist import flatten_codes, load_code_tags, load_codes, write_code_lists, write_code_rows
from widestat.sources.published import publish, read_feed, read_published
from widestat.sources.wide import preview, read_wide, write_wide
from widestat.streaming.feed import feed_schema, in_time_order, write_stream_feed
from widestat.streaming.runner import follow_stream, read_file_stream, run_stream
from widestat.streaming.windowed import drain_windows, late_rows, windowed_max

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the order-table analog of the analysis slices:
# "NATION_1" is a substring of NATION_10..NATION_19, as "EU27" is of "Old_EU27".
ORDER_SLICES = SliceParams(
    token="NATION_1", births_last_year=2001, education_first_year=1995, joined_after=1995,
    births_series="NATION_12", education_wide="NATION_12", education_core="NATION_15",
    h1_series="NATION_19", h2_not_equal="NATION_1", h2_not_containing="NATION_19",
    h3_equal="NATION_18", h3_containing="NATION_12", h4_after=1999, h4_country="NATION_3")

# Fixed label pairs for part names/types: "ECO" is replaced after "ECONOMY"
# became "ECO" (order matters), "$0" must stay literal.
PART_LABEL_PAIRS = (
    ("STANDARD", "STD"),
    ("ECONOMY", "ECO"),
    ("ECO", "E"),
    ("small", "sm"),
    ("PROMO", "PR$0"),
    ("LARGE", "L"),
)
PART_TYPE_LABELS = {"ECONOMY": "Budget", "LARGE": "Big", "SMALL": "Little", "PROMO": "Offer"}
WINDOW = "5 weeks"
# Event stream: daily windows, closed one hour after the newest event seen.
EVENT_WINDOW = "1 day"
EVENT_DELAY = "1 hour"
# Stream replay: files of a micro-batch (the notebooks used 1, a demo value).
FILES_PER_TRIGGER = 8
# Last years of the three arrivals of a polled feed; a year published twice.
POLL_YEARS = (1997, 1999, 9999)
REPUBLISHED_YEAR = 1996
# A mapping of more than a few entries: day of the year -> month-like label.
DAY_LABELS = {str(d): f"day {d:03d}" for d in range(1, 367) if d % 7}


def _split_w(spark: SparkSession, sf: str) -> DataFrame:
    return split_key(cube.orders_wide(spark, sf), "key", cube.EDU_KEY_NAMES)


def q_wide_tsv_scan(spark, sf):
    # Newest year first in the file, as published; read by name.
    wide = cube.orders_wide(spark, sf).select("key", *[str(y) for y in reversed(cube.YEARS)])
    return read_wide(spark, write_wide(wide, scratch_path(spark, "wide-tsv")), cube.YEARS)


def q_csv_roundtrip(spark, sf):
    orders = cube.table(spark, sf, "orders")
    paths = publish({"orders": orders}, scratch_path(spark, "published"))
    return read_published(spark, paths["orders"], schema=orders.schema)


def _orders_feed(spark, sf) -> tuple[str, T.StructType]:
    orders = cube.table(spark, sf, "orders").withColumn("Year", F.year("o_orderdate"))
    path = write_stream_feed(orders, scratch_path(spark, "orders-feed"), "Year")
    return path, feed_schema(orders.schema, "Year", T.TimestampNTZType())


def q_partitioned_feed_scan(spark, sf):
    path, schema = _orders_feed(spark, sf)
    feed = read_feed(spark, path, schema)
    return feed.filter(F.col("Year") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("Year", F.year("Year"))


def q_clean_int(spark, sf):
    return clean_measures(cube.orders_wide(spark, sf), cube.YEARS, kind="int")


def q_clean_double(spark, sf):
    cells = cube.price_cells(spark, sf)
    return cells.select("o_orderkey", "cell", clean_cell(F.col("cell"), "double").alias("value"))


def q_clean_double_null(spark, sf):
    # F2 fixed mode: a missing cell (":") is null, not 0.
    cells = cube.price_cells(spark, sf)
    return cells.select("o_orderkey", "cell",
                        clean_cell(F.col("cell"), "double", missing="null").alias("value"))


def q_split_key(spark, sf):
    return _split_w(spark, sf)


def q_split_key_pivot_form(spark, sf):
    return split_key_pivot_form(cube.orders_wide(spark, sf), "key", cube.EDU_KEY_NAMES)


def q_translate_codes(spark, sf):
    return translate(_split_w(spark, sf), {"Country": cube.GEO_LIST}, cube.nation_codes(spark, sf))


def q_translate_flattened(spark, sf):
    # F7 parity: every list merged into one map, the later list wins.
    return translate(_split_w(spark, sf), ["Country"], cube.nation_codes(spark, sf))


def q_translate_prefixed(spark, sf):
    keys = cube.customer_keys(spark, sf)
    return translate(keys, {"key": cube.GEO_LIST}, cube.nation_codes(spark, sf),
                     prefix=cube.BIRTHS_INDICATOR).withColumnRenamed("key", "Country")


def q_translate_customer_names(spark, sf):
    orders = cube.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    # c_custkey is the customer table's primary key: no dedup aggregate over a
    # dictionary that grows with the data.
    return translate(orders, {"customer": cube.CUSTOMER_LIST}, cube.customer_codes(spark, sf),
                     unique_codes=True)


_PUBLISHED: dict[tuple[str, str], dict[str, str]] = {}


def _published(spark, sf) -> dict[str, str]:
    """The whole flow from files, once per application and input: wide TSVs
    (newest year first) and structure files are written from the order tables,
    run through ``from_files`` with all four key parts translated, and
    published; returns the paths of the nine datasets and the feed."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PUBLISHED:
        base = scratch_path(spark, "files")
        years = [str(y) for y in reversed(cube.YEARS)]
        counts = cube.order_counts(spark, sf)
        births = write_wide(cube.births_wide(spark, sf, counts).select("key", *years), f"{base}/births.tsv")
        education = write_wide(cube.orders_wide(spark, sf, counts).select("key", *years), f"{base}/education.tsv")
        geo = cube.structure_rows(spark, sf).filter(F.col("code_list") == cube.GEO_LIST)
        births_dsd = write_code_lists(geo, f"{base}/births-dsd")
        education_dsd = write_code_lists(cube.education_structure_rows(spark, sf), f"{base}/education-dsd")
        out = etl.from_files(spark, births, births_dsd, education, education_dsd, shape=etl.ORDER_SHAPE)
        _PUBLISHED[key] = etl.publish_all(out, f"{base}/published")
    return _PUBLISHED[key]


PUBLISHED = ("natality", *(f"{kind}-{label}" for label in etl.STRATUM_OUTPUT.values() for kind in ("joined", "education")))


def _published_schema(name: str) -> str:
    return (etl.NATALITY_SCHEMA if name == "natality" else
            etl.JOINED_CT_SCHEMA if name.startswith("joined") else etl.EDUCATION_CT_SCHEMA)


def _published_query(name: str) -> Query:
    def q(spark, sf):
        return read_published(spark, _published(spark, sf)[name], schema=_published_schema(name))
    q.__name__ = f"q_published_{name}"
    return q


def q_published_inferred(spark, sf):
    # The analysis notebook's own read: types inferred from the CSV.
    return read_published(spark, _published(spark, sf)["joined-global"], infer=True)


def q_published_feed(spark, sf):
    data = T._parse_datatype_string(etl.FEED_DATA_SCHEMA)
    feed = read_feed(spark, _published(spark, sf)["stream"], feed_schema(data, "Year", T.TimestampNTZType()))
    return feed.withColumn("Year", F.year("Year"))


def _published_slice(sid: str) -> Query:
    def q(spark, sf):
        paths = _published(spark, sf)
        name = {"births": "natality", "education": "education-global", "joined": "joined-global"}[SLICE_SOURCE[sid]]
        return one_slice(sid, read_published(spark, paths[name], schema=_published_schema(name)), ORDER_SLICES)
    q.__name__ = f"q_published_slice_{sid}"
    return q


def q_codelist_structure_xml(spark, sf):
    path = write_code_lists(cube.structure_rows(spark, sf), scratch_path(spark, "structure"))
    return flatten_codes(load_codes(spark, path, "en")).select("code", "description")


def q_relabel_long_mapping(spark, sf):
    orders = cube.table(spark, sf, "orders").select(
        "o_orderkey", F.dayofyear("o_orderdate").cast("string").alias("day"))
    return relabel(orders, "day", DAY_LABELS)


def q_row_number(spark, sf):
    orders = cube.table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return with_row_id(orders, ["o_orderdate", "o_orderkey"], "row_id").select("o_orderkey", "row_id")


def q_translate_one_join(spark, sf):
    # Two columns through a dictionary that grows with the data, in one join.
    lines = cube.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"),
        F.pmod("o_orderkey", F.lit(1000)).cast("string").alias("contact"))
    return translate(lines, {"customer": cube.CUSTOMER_LIST, "contact": cube.CUSTOMER_LIST},
                     cube.customer_codes(spark, sf), unique_codes=True, row_key="o_orderkey")


def q_preview_lines(spark, sf):
    # The first raw lines of a source, a fixed number by design.
    wide = cube.orders_wide(spark, sf).select("key", *[str(y) for y in reversed(cube.YEARS)])
    path = write_wide(wide.orderBy("key"), scratch_path(spark, "preview"))
    return preview(spark, f"{path}/part-00000-*", 10)


def _codes_xml(spark, sf) -> str:
    return write_code_rows(cube.code_rows(spark, sf), scratch_path(spark, "codelists"))


def q_codelist_xml(spark, sf):
    codes = load_codes(spark, _codes_xml(spark, sf), "en", row_tag="Code")
    return codes.select("code_list", "code", "lang", "description")


def q_codelist_xml_missing_lang(spark, sf):
    codes = load_codes(spark, _codes_xml(spark, sf), "de", row_tag="Code")
    return codes.select("code_list", "code", "lang", "description")


def q_shorten_labels(spark, sf):
    part = cube.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return shorten(part, "label", PART_LABEL_PAIRS)


def q_relabel_bands(spark, sf):
    part = cube.table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("From "), F.col("p_size").cast("string"), F.lit(" to "),
                 (F.col("p_size") + 9).cast("string"), F.lit(" years")).alias("band"),
        F.col("p_type").alias("type_label"))
    return relabel(relabel_age(part, "band"), "type_label", PART_TYPE_LABELS)


def q_domain_profile(spark, sf):
    return domain_profile(_split_w(spark, sf), list(cube.EDU_KEY_NAMES))


def q_restrict_total(spark, sf):
    return restrict(_split_w(spark, sf), {"Citizen": cube.CITIZEN_TOTAL})


def q_wide_to_long(spark, sf):
    clean = clean_measures(cube.orders_wide(spark, sf), cube.YEARS, kind="int", missing="null")
    return wide_to_long(clean, ["key"], cube.YEARS, "Year", "value")


def q_natality_long(spark, sf):
    return etl.from_orders(spark, sf).natality


def q_education_long(spark, sf):
    return etl.from_orders(spark, sf).education


def _crosstab(name: str) -> Query:
    def q(spark, sf):
        return etl.from_orders(spark, sf).education_stratum(name)
    q.__name__ = f"q_crosstab_{name}"
    return q


def q_crosstab_all_segments(spark, sf):
    # F12 made explicit: the segment dimension is dropped on purpose and the
    # cross-tab adds across its values (sum_over) instead of fixing one.
    education = etl.education_long(
        cube.orders_wide(spark, sf), cube.nation_codes(spark, sf), cube.YEARS, cube.EDU_KEY_NAMES,
        {"Country": cube.GEO_LIST}, {}, sum_over=["Citizen"], label_pairs=())
    return crosstab(education, ["Country", "Year"], "Education_Attainment", cube.ATTAINMENT_VALUES,
                    "Proportion", "Age", cube.STRATA["global"], unlisted="fail")


def _joined(name: str) -> Query:
    def q(spark, sf):
        return etl.from_orders(spark, sf).joined(name)
    q.__name__ = f"q_join_facts_{name}"
    return q


def _slice(sid: str) -> Query:
    def q(spark, sf):
        out = etl.from_orders(spark, sf)
        source = SLICE_SOURCE[sid]
        frame = (out.natality if source == "births" else
                 out.education_stratum("global") if source == "education" else out.joined("global"))
        return one_slice(sid, frame, ORDER_SLICES)
    q.__name__ = f"q_slice_{sid}"
    return q


def q_lineitem_crosstab(spark, sf):
    clean = clean_measures(cube.lineitem_wide(spark, sf), cube.YEARS, kind="double")
    named = translate(split_key(clean, "key", cube.LINE_KEY_NAMES), {"Country": cube.GEO_LIST},
                      cube.nation_codes(spark, sf))
    long = wide_to_long(named, ["Flag", "Status", "Country"], cube.YEARS, "Year", "Quantity")
    ct = stratum_crosstab(long, cube.LINE_STRATA, "Status", ["Country", "Year"], "Flag",
                          cube.FLAG_VALUES, "Quantity", unlisted="fail")
    return ct.filter(F.col("stratum") == "finished").drop("stratum")


def q_windowed_max_batch(spark, sf):
    orders = cube.table(spark, sf, "orders")
    return windowed_max(orders, ["o_orderstatus"], "o_orderdate", "o_totalprice", WINDOW, min_year=1995)


def q_windowed_max_stream(spark, sf):
    path, schema = _orders_feed(spark, sf)
    stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
    agg = windowed_max(stream, ["o_orderstatus"], "o_orderdate", "o_totalprice", WINDOW, min_year=1995)
    return run_stream(agg, "orders_window_max", "complete")


def q_stream_sql(spark, sf):
    education = etl.from_orders(spark, sf).education
    path = write_stream_feed(education, scratch_path(spark, "education-feed"), "Year")
    schema = feed_schema(education.schema, "Year", T.TimestampNTZType())
    stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
    agg = windowed_max(stream, ["Country"], "Year", "Proportion", WINDOW, min_year=1995)
    run_stream(agg, "counts", "complete")
    return spark.sql("SELECT Country, window_start, window_end, max_Proportion FROM counts")


def _events_feed(spark, sf) -> tuple[str, T.StructType]:
    events = (cube.table(spark, sf, "events").select("event_type", "ts", "value")
              .withColumn("day", F.to_date("ts")))
    path = write_stream_feed(events, scratch_path(spark, "events-feed"), "day", year_int=False)
    return in_time_order(spark, path), feed_schema(events.schema, "day", T.DateType())


def q_windowed_max_watermark(spark, sf):
    # Append output yields a window once the watermark has passed its end; the
    # windows still open when the input ends are read from the state store.
    path, schema = _events_feed(spark, sf)
    stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
    agg = windowed_max(stream, ["event_type"], "ts", "value", EVENT_WINDOW, watermark=EVENT_DELAY)
    return drain_windows(agg, "events_daily_max", ["event_type"])[0]


def q_windowed_max_update(spark, sf):
    # The form for feeds that grow: the state holds open windows only, and
    # only changed rows are written.
    path, schema = _events_feed(spark, sf)
    stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
    agg = windowed_max(stream, ["event_type"], "ts", "value", EVENT_WINDOW, watermark=EVENT_DELAY)
    return run_stream(agg, "events_daily_max_update", "update", keys=["event_type", "window_start", "window_end"])


def _late_feed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All events but those of the first day are read first, the first day
    comes when its windows are closed: (every window, what was lost)."""
    events = cube.table(spark, sf, "events").select("event_type", "ts", "value").withColumn("day", F.to_date("ts"))
    first = F.lit(events.agg(F.min("day")).first()[0])
    path, out, ckpt = (scratch_path(spark, f"late-{n}") for n in ("feed", "windows", "checkpoint"))
    schema = feed_schema(events.schema, "day", T.DateType())

    def drain():
        stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
        agg = windowed_max(stream, ["event_type"], "ts", "value", EVENT_WINDOW, watermark=EVENT_DELAY, rows="n_rows")
        return drain_windows(agg, "events_late", ["event_type"], path=out, checkpoint=ckpt)

    write_stream_feed(events.where(F.col("day") > first), path, "day", year_int=False)
    in_time_order(spark, path)
    _, on_time = drain()
    write_stream_feed(events.where(F.col("day") == first), path, "day", year_int=False, replace="present")
    windows, late = drain()
    return windows, late_rows(windows, "n_rows", [on_time, late])


def q_late_rows(spark, sf):
    return _late_feed(spark, sf)[1]


def q_late_windows(spark, sf):
    return _late_feed(spark, sf)[0]


def q_stream_polls(spark, sf):
    # The notebooks' loop: a stream that keeps running, read three times while
    # more years arrive; every read is a whole epoch.
    orders = cube.table(spark, sf, "orders").withColumn("Year", F.year("o_orderdate"))
    path, polls = scratch_path(spark, "polled-feed"), scratch_path(spark, "polls")
    schema = feed_schema(orders.drop("Year").schema, "Year", T.TimestampNTZType())
    running = None
    for poll, (after, upto) in enumerate(zip((0, *POLL_YEARS), POLL_YEARS), start=1):
        write_stream_feed(orders.where(F.col("Year").between(after + 1, upto)), path, "Year", replace="present")
        if running is None:
            stream = read_file_stream(spark, path, schema, max_files_per_trigger=FILES_PER_TRIGGER)
            agg = windowed_max(stream, ["o_orderstatus"], "o_orderdate", "o_totalprice", WINDOW, min_year=1995)
            running = follow_stream(agg, "orders_polled", "complete")
        try:
            running.catch_up().read().withColumn("poll", F.lit(poll)).write.mode("append").parquet(polls)
        except Exception:
            running.stop()
            raise
    running.stop()
    return spark.read.parquet(polls)


def q_feed_republished(spark, sf):
    # One year of the feed was published with wrong prices and comes again; the
    # folders of the other years are not written.
    orders = cube.table(spark, sf, "orders")
    dated = orders.withColumn("Year", F.year("o_orderdate"))
    wrong = F.when(F.col("Year") == REPUBLISHED_YEAR, F.lit(-1.0)).otherwise(F.col("o_totalprice"))
    path = write_stream_feed(dated.withColumn("o_totalprice", wrong), scratch_path(spark, "republished-feed"), "Year")
    write_stream_feed(dated.where(F.col("Year") == REPUBLISHED_YEAR), path, "Year", replace="present")
    return read_feed(spark, path, feed_schema(orders.schema, "Year", T.TimestampNTZType())).withColumn("Year", F.year("Year"))


def q_crosstab_discovered(spark, sf):
    # The pivot's values are found, declared nowhere: every nation has a column,
    # also one without suppliers.
    lines = cube.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    supplier = cube.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = cube.table(spark, sf, "nation").select("n_nationkey", "n_name")
    named = (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return crosstab(named, ["l_returnflag"], "n_name", discover_values(nation, "n_name"), "q", unlisted="fail")


def q_split_key_pivot_discovered(spark, sf):
    return split_key_pivot_form(cube.orders_wide(spark, sf), "key", None)


def q_lost_cells(spark, sf):
    # Counted while the table is cleaned and written, not by another pass.
    seen = Observation()
    clean = clean_measures(cube.dirty_wide(spark, sf), cube.YEARS, kind="double", missing="null", observation=seen)
    clean.write.parquet(scratch_path(spark, "cleaned"))
    return lost_cells(spark, seen)


def q_codelist_tags(spark, sf):
    # One list that grows with the customers, split over tasks by tags.
    path = write_code_lists(cube.one_list_rows(spark, sf), scratch_path(spark, "one-list"))
    return load_code_tags(spark, path, "en").select("code_list", "code", "lang", "description")


def q_row_number_ties(spark, sf):
    # Three values over all orders: numbers are dense, and each value's are consecutive.
    orders = cube.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return (with_row_id(orders, ["o_orderstatus"], "row_id").groupBy("o_orderstatus")
            .agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count_distinct("row_id").alias("n_ids")))


def q_trend(spark, sf):
    out = trend(etl.from_orders(spark, sf).natality, "Country", "Year", "Births")
    return out.withColumn("slope", F.round("slope", 6))


def q_co_movement(spark, sf):
    out = co_movement(etl.from_orders(spark, sf).joined("global"), "Country", "Births", "F")
    return out.withColumn("corr", F.round("corr", 6))


def q_series_gap(spark, sf):
    return series_gap(etl.from_orders(spark, sf).natality, "Country", "Year", "Births",
                      "NATION_12", "NATION_15")


def q_risers(spark, sf):
    return risers(etl.from_orders(spark, sf).natality, "Country", "Year", "Births", 1998, 2000)


def queries() -> dict[str, Query]:
    reg: dict[str, Query] = {
        "wide_tsv_scan": q_wide_tsv_scan,
        "csv_roundtrip": q_csv_roundtrip,
        "partitioned_feed_scan": q_partitioned_feed_scan,
        "clean_int": q_clean_int,
        "clean_double": q_clean_double,
        "clean_double_null": q_clean_double_null,
        "split_key": q_split_key,
        "split_key_pivot_form": q_split_key_pivot_form,
        "translate_codes": q_translate_codes,
        "translate_flattened": q_translate_flattened,
        "translate_prefixed": q_translate_prefixed,
        "translate_customer_names": q_translate_customer_names,
        "codelist_xml": q_codelist_xml,
        "codelist_xml_missing_lang": q_codelist_xml_missing_lang,
        "shorten_labels": q_shorten_labels,
        "relabel_bands": q_relabel_bands,
        "domain_profile": q_domain_profile,
        "restrict_total": q_restrict_total,
        "wide_to_long": q_wide_to_long,
        "natality_long": q_natality_long,
        "education_long": q_education_long,
    }
    for s in cube.STRATA:
        reg[f"crosstab_{s}"] = _crosstab(s)
    reg["crosstab_all_segments"] = q_crosstab_all_segments
    for s in cube.STRATA:
        reg[f"join_facts_{s}"] = _joined(s)
    for i in range(1, 14):
        reg[f"slice_n{i}"] = _slice(f"n{i}")
    for name in PUBLISHED:
        reg[f"published_{name.replace('-', '_')}"] = _published_query(name)
    reg["published_inferred"] = q_published_inferred
    reg["published_feed"] = q_published_feed
    for i in range(1, 14):
        reg[f"published_slice_n{i}"] = _published_slice(f"n{i}")
    reg.update({
        "codelist_structure_xml": q_codelist_structure_xml,
        "relabel_long_mapping": q_relabel_long_mapping,
        "row_number": q_row_number,
        "translate_one_join": q_translate_one_join,
        "preview_lines": q_preview_lines,
        "windowed_max_update": q_windowed_max_update,
    })
    reg["lineitem_crosstab"] = q_lineitem_crosstab
    reg.update({
        "windowed_max_batch": q_windowed_max_batch,
        "windowed_max_stream": q_windowed_max_stream,
        "stream_sql": q_stream_sql,
        "windowed_max_watermark": q_windowed_max_watermark,
        "trend": q_trend,
        "co_movement": q_co_movement,
        "series_gap": q_series_gap,
        "risers": q_risers,
        "late_rows": q_late_rows,
        "late_windows": q_late_windows,
        "stream_polls": q_stream_polls,
        "feed_republished": q_feed_republished,
        "crosstab_discovered": q_crosstab_discovered,
        "split_key_pivot_discovered": q_split_key_pivot_discovered,
        "lost_cells": q_lost_cells,
        "codelist_tags": q_codelist_tags,
        "row_number_ties": q_row_number_ties,
    })
    return reg
