"""Tumbling-window maximum per key, the same function for a batch frame
and a streaming one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widestat.session import scratch_path
from widestat.streaming.runner import Files, StreamReport, run_stream_reported


def windowed_max(df: DataFrame, keys: Sequence[str], ts: str, measure: str,
                 width: str = "5 weeks", min_year: int | None = None,
                 watermark: str | None = None, out: str | None = None,
                 flatten: bool = True, rows: str | None = None) -> DataFrame:
    """``max(measure)`` per key and epoch-aligned ``width`` window of ``ts``.

    min_year: keep events whose year is after this: a range on ``ts`` itself,
        so it reaches the scan (on a folder column it prunes whole folders).
    watermark: bound the state (and allow append output); ``None`` keeps every
        window for ever, as the notebook did.
    flatten: ``window`` struct -> ``window_start``, ``window_end``.
    rows: a column of this name counts the rows of the window.
    """
    dtype = df.schema[ts].dataType
    if isinstance(dtype, T.StringType):
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts)))
    if min_year is not None:
        first = df.select(ts).schema[ts].dataType
        df = df.filter(F.col(ts) >= F.lit(f"{min_year + 1}-01-01 00:00:00").cast(first))
    # A watermark needs TIMESTAMP event time.  Wall-clock (NTZ) times are read
    # as UTC instants, so windows stay aligned to wall-clock boundaries in any
    # session time zone; the bounds are turned back into wall clock below.
    wall_clock = watermark is not None and isinstance(dtype, T.TimestampNTZType)
    if wall_clock:
        df = df.withColumn(ts, F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp"))
    if watermark is not None:
        df = df.withWatermark(ts, watermark)
    name = out or f"max_{measure}"
    agg = df.groupBy(*keys, F.window(F.col(ts), width).alias("window")).agg(
        F.max(measure).alias(name), *([F.count(F.lit(1)).alias(rows)] if rows else []))
    if not flatten:
        return agg
    start, end = F.col("window.start"), F.col("window.end")
    if wall_clock:
        start, end = _wall_clock(start, df.sparkSession), _wall_clock(end, df.sparkSession)
    return agg.select(*keys, start.alias("window_start"), end.alias("window_end"), name, *([rows] if rows else []))


def _wall_clock(instant: Column, spark: SparkSession) -> Column:
    """A UTC instant as the wall-clock time it was read from."""
    zone = F.lit(spark.conf.get("spark.sql.session.timeZone"))
    return F.convert_timezone(zone, F.lit("UTC"), instant.cast("timestamp_ntz"))


def open_windows(agg: DataFrame, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """The windows that a drained ``windowed_max`` stream still holds: its own
    state store, read as a table in the shape of ``agg``.  In append output
    these are the windows that the watermark has not closed, so together with
    what the sink has they are every window, once, without a second pass over
    the input.  Without a micro-batch there is no state and no window."""
    spark = agg.sparkSession
    if not Files(spark, checkpoint).exists("state/0"):
        return spark.createDataFrame([], agg.schema)
    state = spark.read.format("statestore").load(checkpoint)
    values = [f.name for f in state.schema["value"].dataType]
    measures = [f for f in agg.schema if f.name not in (*keys, "window_start", "window_end")]

    def bound(name: str) -> Column:
        at = F.col(f"key.window.{name}")
        return _wall_clock(at, spark) if isinstance(agg.schema["window_start"].dataType, T.TimestampNTZType) else at

    return state.select(*[F.col("key").getField(k).alias(k) for k in keys], bound("start").alias("window_start"), bound("end").alias("window_end"),
                        *[F.col("value").getField(v).cast(m.dataType).alias(m.name) for v, m in zip(values, measures)]).select(*agg.columns)


def drain_windows(agg: DataFrame, name: str, keys: Sequence[str], path: str | None = None,
                  checkpoint: str | None = None) -> tuple[DataFrame, StreamReport]:
    """Drain a ``windowed_max`` stream with a watermark in append output: every
    window, the closed ones from the exactly-once sink and the open ones from
    the state, and what the run read and lost.  Called again with the same
    ``path`` and ``checkpoint`` it takes in what is new."""
    spark = agg.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    closed, report = run_stream_reported(agg, name, "append", path=path, checkpoint=checkpoint)
    return closed.unionByName(open_windows(agg, checkpoint, keys)), report


def late_rows(windows: DataFrame, rows_col: str, reports: Sequence[StreamReport]) -> DataFrame:
    """(input_rows, kept_rows, late_rows): what the runs read, what the windows
    hold, and the difference, which is what came after its window had closed.
    Exact, whatever tasks folded before the state saw a row.  ``rows_col`` counts
    the rows of a window; the stream must not filter rows away itself."""
    read = sum(r.input_rows for r in reports)
    kept = windows.agg(F.sum(rows_col)).first()[0] or 0  # one number
    return windows.sparkSession.createDataFrame([(read, kept, read - kept)], "input_rows long, kept_rows long, late_rows long")
