import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from widestat.sources.published import read_feed
from widestat.streaming.feed import feed_schema, in_time_order, write_stream_feed
from widestat.streaming.runner import current_epoch, follow_stream, read_file_stream, result_table, run_stream, run_stream_reported
from widestat.streaming.windowed import drain_windows, late_rows, open_windows, windowed_max

EDU = "Education_Attainment string, Age string, Country string, Year int, Proportion double"


def education(spark):
    data = []
    for y in range(2004, 2011):
        for c in ("AT", "BE", "EU28"):
            for a in ("Secondary", "Tertiary"):
                data.append((a, "18-74", c, y, float(y - 2000) + (0.5 if a == "Tertiary" else 0.0)))
    return spark.createDataFrame(data, EDU)


def test_one_january_windows(spark):
    # 5-week tumbling windows are epoch-aligned (UTC).
    df = spark.createDataFrame([(dt.datetime(2005, 1, 1),), (dt.datetime(2020, 1, 1),), (dt.datetime(1969, 12, 31),)],
                               "ts timestamp_ntz").withColumn("v", F.lit(1.0)).withColumn("k", F.lit("a"))
    out = windowed_max(df, ["k"], "ts", "v", "5 weeks")
    starts = sorted(r.window_start for r in out.collect())
    assert starts == [dt.datetime(1969, 11, 27), dt.datetime(2004, 12, 23), dt.datetime(2019, 12, 5)]


def test_feed_round_trip_and_pruning(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    assert any(d.startswith("Year=2005-01-01 00%3A00%3A00") for d in os.listdir(path))
    back = read_feed(spark, path, feed_schema(edu.schema, "Year"))
    cut = back.filter(F.col("Year") >= F.lit("2005-01-01 00:00:00").cast("timestamp"))
    assert "PartitionFilters: [isnotnull(Year" in cut._jdf.queryExecution().executedPlan().toString()
    got = rows(cut.withColumn("Year", F.year("Year")), *edu.columns)
    assert got == rows(edu.filter("Year > 2004"), *edu.columns)


def test_stream_equals_batch(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    schema = feed_schema(edu.schema, "Year")
    stream = read_file_stream(spark, path, schema, max_files_per_trigger=1)
    streamed = run_stream(windowed_max(stream, ["Country"], "Year", "Proportion", min_year=2004),
                          "edu_max_test", "complete", path=os.path.join(workdir, "out"),
                          checkpoint=os.path.join(workdir, "ckpt"))
    batch = windowed_max(read_feed(spark, path, schema), ["Country"], "Year", "Proportion", min_year=2004)
    assert streamed.count() == 3 * 6
    assert rows(streamed) == rows(batch)
    assert spark.sql("SELECT count(*) AS n FROM edu_max_test").first().n == 18


def test_memory_sink_parity(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    stream = read_file_stream(spark, path, feed_schema(edu.schema, "Year"), max_files_per_trigger=1)
    out = run_stream(windowed_max(stream, ["Country"], "Year", "Proportion", min_year=2004),
                     "counts_mem_test", "complete", sink="memory", checkpoint=os.path.join(workdir, "ck"))
    assert out.count() == 18


def test_wrong_schema_fails_loudly(spark, workdir):
    # a schema in the wrong order used to put attainment labels into
    # Country and nulls into Proportion; with header checking it fails.
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    wrong = T.StructType([T.StructField("Country", T.StringType()), T.StructField("Year", T.TimestampType()),
                          T.StructField("Education_Attainment", T.StringType()),
                          T.StructField("Proportion", T.DoubleType())])
    stream = read_file_stream(spark, path, wrong, max_files_per_trigger=1)
    with pytest.raises(Exception):
        run_stream(windowed_max(stream, ["Country"], "Year", "Proportion"), "wrong_schema_test",
                   "complete", path=os.path.join(workdir, "o"), checkpoint=os.path.join(workdir, "c"))


def test_watermark_drops_late_rows(spark, workdir):
    src = os.path.join(workdir, "events")
    os.makedirs(src)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("v", T.DoubleType())])
    batches = [
        [("a", "2020-03-01 00:00:00", 1.0)],
        [("a", "2020-09-01 00:00:00", 2.0)],
        [("a", "2020-10-01 00:00:00", 4.0)],
        # late: older than the watermark the previous batch ended with
        [("a", "2020-03-02 00:00:00", 9.0)],
        [("a", "2021-06-01 00:00:00", 3.0)],
    ]
    for i, b in enumerate(batches):
        with open(os.path.join(src, f"part-{i}.csv"), "w") as f:
            f.write("k,ts,v\n" + "".join(f"{k},{t},{v}\n" for k, t, v in b))
        os.utime(os.path.join(src, f"part-{i}.csv"), (1_000_000 + i, 1_000_000 + i))
    def run(watermark, name):
        stream = read_file_stream(spark, src, schema, max_files_per_trigger=1)
        agg = windowed_max(stream, ["k"], "ts", "v", "5 weeks", watermark=watermark)
        return run_stream(agg, name, "append" if watermark else "complete",
                          path=os.path.join(workdir, name), checkpoint=os.path.join(workdir, name + "_ck"))
    kept = {r.max_v for r in run(None, "no_wm").collect()}
    assert 9.0 in kept
    dropped = {r.max_v for r in run("1 day", "wm").collect()}
    assert 9.0 not in dropped and 1.0 in dropped


def test_empty_feed_gives_empty_result(spark, workdir):
    src = os.path.join(workdir, "empty")
    os.makedirs(src)
    edu = education(spark)
    stream = read_file_stream(spark, src, feed_schema(edu.schema, "Year"), max_files_per_trigger=1)
    out = run_stream(windowed_max(stream, ["Country"], "Year", "Proportion"), "empty_test", "complete",
                     path=os.path.join(workdir, "o"), checkpoint=os.path.join(workdir, "c"))
    assert out.count() == 0
    assert out.columns == ["Country", "window_start", "window_end", "max_Proportion"]


def test_year_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = windowed_max(orders, ["o_orderstatus"], "o_orderdate", "o_totalprice", min_year=1995)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00" in plan._jdf.queryExecution().executedPlan().toString()


def test_feed_files_follow_the_bytes(spark, workdir):
    def files(n, name):
        df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(2005).alias("Year"))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        try:
            path = write_stream_feed(df, os.path.join(workdir, name), "Year")
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        return sum(f.endswith(".csv") for _, _, fs in os.walk(path) for f in fs)
    few, many = files(1_000, "few"), files(40_000, "many")
    assert few <= 2 and many >= 4  # one hot folder, many writers
    df = spark.range(1_000).select(F.col("id"), F.lit(2005).alias("Year"))
    path = write_stream_feed(df, os.path.join(workdir, "rows"), "Year", max_records_per_file=100)
    assert sum(f.endswith(".csv") for _, _, fs in os.walk(path) for f in fs) >= 10


def test_unreadable_result_is_an_error(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    stream = read_file_stream(spark, path, feed_schema(edu.schema, "Year"), max_files_per_trigger=None)
    agg = windowed_max(stream, ["Country"], "Year", "Proportion", watermark="1 day")
    out = os.path.join(workdir, "out")
    done = run_stream(agg, "broken_test", "append", path=out, checkpoint=os.path.join(workdir, "ck"))
    assert done.count() > 0
    for d, _, fs in os.walk(out):
        for f in fs:
            if f.endswith(".parquet"):
                with open(os.path.join(d, f), "wb") as broken:
                    broken.write(b"not parquet")
    with pytest.raises(Exception):
        spark.read.schema(agg.schema).parquet(out).collect()


def test_open_windows_come_from_the_state(spark, workdir):
    """Closed windows and those in the state are all windows, once each; for
    instants and wall-clock times alike, and without any micro-batch."""
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    for kind in (T.TimestampType(), T.TimestampNTZType()):
        schema = feed_schema(edu.schema, "Year", kind)
        agg = windowed_max(read_file_stream(spark, path, schema, None), ["Country"], "Year", "Proportion", watermark="1 day", rows="n")
        ckpt = os.path.join(workdir, f"c{kind.simpleString()}")
        closed = run_stream(agg, "closed_test", "append", path=os.path.join(workdir, f"o{kind.simpleString()}"), checkpoint=ckpt)
        held = open_windows(agg, ckpt, ["Country"])
        every = windowed_max(read_feed(spark, path, schema), ["Country"], "Year", "Proportion", rows="n")
        assert 0 < closed.count() < every.count() and held.dtypes == agg.dtypes
        assert rows(closed.unionByName(held)) == rows(every)
    none = os.path.join(workdir, "never")
    assert open_windows(agg, none, ["Country"]).count() == 0


def test_update_output_keeps_the_latest_row(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    schema = feed_schema(edu.schema, "Year")
    agg = windowed_max(read_file_stream(spark, path, schema, 1), ["Country"], "Year", "Proportion", watermark="3650 days")
    got = run_stream(agg, "update_test", "update", keys=["Country", "window_start", "window_end"],
                     path=os.path.join(workdir, "o"), checkpoint=os.path.join(workdir, "c"))
    assert rows(got) == rows(windowed_max(read_feed(spark, path, schema), ["Country"], "Year", "Proportion"))
    with pytest.raises(ValueError):
        run_stream(agg, "update_test_2", "update")


def test_streamed_windows_alone_are_complete(spark, workdir):
    """Several files a day, written in any order: the stream loses no window
    that its watermark closes, and a lost one is not filled from the batch."""
    first = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(f"k{i % 2}", first + dt.timedelta(minutes=30 * i), float(i * 7919 % 1000)) for i in range(480)],
                                   "k string, ts timestamp_ntz, v double").withColumn("day", F.to_date("ts"))
    path = write_stream_feed(events, os.path.join(workdir, "feed"), "day", year_int=False, max_records_per_file=12)
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".csv"))
    assert len(files) >= 40
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + i * 17 % len(files),) * 2)
    schema = feed_schema(events.schema, "day", T.DateType())
    agg = windowed_max(read_file_stream(spark, in_time_order(spark, path), schema, 3), ["k"], "ts", "v", "1 day", watermark="1 hour")
    closed = run_stream(agg, "ordered_test", "append", path=os.path.join(workdir, "o"), checkpoint=os.path.join(workdir, "c"))
    feed = read_feed(spark, path, schema)
    every = windowed_max(feed, ["k"], "ts", "v", "1 day")
    last = F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    assert rows(closed) == rows(every.where(F.col("window_end") < last)) and closed.count() == 18
    assert rows(closed.unionByName(open_windows(agg, os.path.join(workdir, "c"), ["k"]))) == rows(every)


@pytest.mark.parametrize("mode,keys", [("complete", ()), ("update", ("Country", "window_start", "window_end")), ("append", ())])
def test_a_rerun_keeps_its_result(spark, workdir, mode, keys):
    """The same path and checkpoint: without new files the earlier result, with
    a new one the whole of both."""
    edu = education(spark)
    path = write_stream_feed(edu.where("Year < 2009"), os.path.join(workdir, "feed"), "Year")
    schema = feed_schema(edu.schema, "Year")

    def run():
        agg = windowed_max(read_file_stream(spark, path, schema, 2), ["Country"], "Year", "Proportion",
                           watermark=None if mode == "complete" else "1 day")
        return run_stream_reported(agg, "rerun_test", mode, path=os.path.join(workdir, "o"), checkpoint=os.path.join(workdir, "c"), keys=keys)

    first, report = run()
    want = rows(first)
    assert report.input_rows == 5 * 6 and len(want) >= 3
    again, report = run()
    assert rows(again) == want and report.input_rows == 0
    write_stream_feed(edu.where("Year >= 2009"), path, "Year", replace="present")
    more, report = run()
    assert report.input_rows == 2 * 6 and set(want) < set(rows(more))
    every = windowed_max(read_feed(spark, path, schema), ["Country"], "Year", "Proportion")
    assert set(rows(more)) <= set(rows(every)) and (mode == "append" or rows(more) == rows(every))


def test_running_stream_is_read_in_whole_epochs(spark, workdir):
    edu = education(spark)
    path, out, ckpt = (os.path.join(workdir, n) for n in ("feed", "o", "c"))
    schema = feed_schema(edu.schema, "Year")

    def start():
        agg = windowed_max(read_file_stream(spark, path, schema, 1), ["Country"], "Year", "Proportion")
        return follow_stream(agg, "running_test", "complete", path=out, checkpoint=ckpt)

    os.makedirs(path)
    with start() as running:
        assert running.read().count() == 0
        kept = None
        for upto in (2005, 2007, 2010):
            write_stream_feed(edu.where(f"Year between {upto - 1} and {upto}"), path, "Year", replace="present")
            table = running.catch_up().read()
            want = windowed_max(read_feed(spark, path, schema), ["Country"], "Year", "Proportion")
            assert rows(table) == rows(want) == rows(spark.table("running_test"))
            if kept is None:
                kept = (table, rows(table))
        last = rows(table)
    assert os.path.exists(os.path.join(out, f"epoch={current_epoch(spark, out)}")) and not os.path.exists(os.path.join(out, "_current.next"))
    with start() as running:  # started again: the result is there before any batch
        assert rows(running.read()) == last


def test_pointer_names_only_whole_epochs(spark, workdir):
    """An epoch that was being written when the stream died is not read."""
    edu = education(spark)
    path, out = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year"), os.path.join(workdir, "o")
    schema = feed_schema(edu.schema, "Year")
    for mode, keys in (("complete", ()), ("update", ("Country", "window_start", "window_end"))):
        at = out + mode
        agg = windowed_max(read_file_stream(spark, path, schema, None), ["Country"], "Year", "Proportion")
        want = rows(run_stream(agg, "whole_test", mode, path=at, checkpoint=os.path.join(workdir, "c" + mode), keys=keys))
        broken = agg.schema
        spark.createDataFrame([("XX", None, None, 99.0)], broken).write.parquet(f"{at}/epoch={current_epoch(spark, at) + 1}")
        assert rows(result_table(spark, at, broken, mode, keys)) == want


def test_late_rows_are_counted_exactly(spark, workdir):
    """Rows behind a closed window: each is counted, though tasks fold them
    before the state drops them; what comes in time is not."""
    day = dt.datetime(2024, 1, 1)
    on_time = [(f"k{i % 3}", day + dt.timedelta(days=1, minutes=10 * i), float(i)) for i in range(600)]
    late = [("k0", day + dt.timedelta(minutes=i), 1000.0) for i in range(70)] + [("new", day + dt.timedelta(days=2), 5.0)]
    in_time = [("k1", day + dt.timedelta(days=5, hours=2), 7.0)] * 4
    schema = "k string, ts timestamp_ntz, v double"
    path, out, ckpt = (os.path.join(workdir, n) for n in ("feed", "o", "c"))

    def drain():
        feed = feed_schema(T._parse_datatype_string(schema), "day", T.DateType())
        agg = windowed_max(read_file_stream(spark, path, feed, None), ["k"], "ts", "v", "1 day", watermark="1 hour", rows="n")
        return drain_windows(agg, "late_test", ["k"], path=out, checkpoint=ckpt)

    write_stream_feed(spark.createDataFrame(on_time, schema).withColumn("day", F.to_date("ts")), path, "day", year_int=False)
    windows, first = drain()
    assert first.dropped_by_watermark == 0 and first.watermark == "2024-01-06T02:50:00.000Z"
    assert late_rows(windows, "n", [first]).collect() == [(600, 600, 0)]
    # Three files of another folder level's day: late rows, and some still in time.
    extra = spark.createDataFrame(late + in_time, schema).withColumn("day", F.lit("2030-01-01").cast("date"))
    write_stream_feed(extra, path, "day", year_int=False, replace="present")
    windows, second = drain()
    assert second.input_rows == 75 and 0 < second.dropped_by_watermark <= 71
    assert late_rows(windows, "n", [first, second]).collect() == [(675, 604, 71)]
    assert windows.where("k = 'new' or max_v = 1000").count() == 0


def test_republishing_a_year_leaves_the_others(spark, workdir):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".csv")}
    before = files()
    again = edu.where("Year = 2006").withColumn("Proportion", F.lit(1.5)).unionByName(
        edu.where("Year = 2010").withColumn("Year", F.lit(2011)))  # a corrected year and a new one
    write_stream_feed(again, path, "Year", replace="present")
    after = files()
    same = {f: t for f, t in before.items() if "Year=2006" not in f}
    assert same.items() <= after.items() and len(same) < len(after)
    back = read_feed(spark, path, feed_schema(edu.schema, "Year")).withColumn("Year", F.year("Year"))
    assert rows(back, *edu.columns) == rows(edu.where("Year <> 2006").unionByName(again), *edu.columns)
    write_stream_feed(again, path, "Year")
    assert {f.split("Year=")[1][:4] for f in files()} == {"2006", "2011"}
    with pytest.raises(ValueError):
        write_stream_feed(again, path, "Year", replace="some")


def test_feed_order_needs_file_times(spark, workdir, monkeypatch):
    edu = education(spark)
    path = write_stream_feed(edu, os.path.join(workdir, "feed"), "Year")
    assert in_time_order(spark, path) == path
    import widestat.streaming.feed as feed

    class Deaf:  # a store that ignores setTimes
        def __init__(self, fs):
            self.fs = fs

        def setTimes(self, *_):
            pass

        def __getattr__(self, name):
            return getattr(self.fs, name)
    monkeypatch.setattr(feed, "_file_system", lambda *a, f=feed._file_system: Deaf(f(*a)))
    with pytest.raises(RuntimeError, match="file times"):
        in_time_order(spark, path)
