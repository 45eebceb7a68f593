"""Run a streaming query and expose its result as a named table that SQL
can query: drained to the end of its input, or read while it runs."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from widestat.session import scratch_path

#: Under a result's path: the last whole epoch, replaced in one move.
POINTER = "_current"
#: Complete results that stay behind the current one, for readers that began earlier.
KEPT_EPOCHS = 1


def read_file_stream(spark: SparkSession, path: str, schema: T.StructType,
                     max_files_per_trigger: int | None = 1, fmt: str = "csv") -> DataFrame:
    """A file source with a declared schema, ``max_files_per_trigger`` files
    per micro-batch (``None`` = all new files)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


class Files:
    """Small files beside a result, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.base = base
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside and move over in one step, so a reader sees the old or the new text."""
        beside = f"{name}.next"
        out = self.fs.create(self.path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        at = self.fs.makeQualified(self.path(name))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(self.path(beside)), at, options)


def current_epoch(spark: SparkSession, target: str) -> int | None:
    """The last whole epoch of a complete or update result, None before the first."""
    files = Files(spark, target)
    return int(files.read(POINTER)) if files.exists(POINTER) else None


def result_table(spark: SparkSession, target: str, schema: T.StructType, output_mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """What a stream has written to ``target`` so far, as of its last whole
    epoch, whether the stream runs, has ended or is yet to start again."""
    if output_mode == "append":
        return (spark.read.schema(schema).parquet(target) if Files(spark, target).exists("_spark_metadata")
                else spark.createDataFrame([], schema))
    epoch = current_epoch(spark, target)
    if epoch is None:
        return spark.createDataFrame([], schema)
    if output_mode == "complete":
        return spark.read.schema(schema).parquet(f"{target}/epoch={epoch}")
    every = spark.read.parquet(target).where(F.col("epoch") <= epoch)
    rest = [f.name for f in schema if f.name not in keys]
    return (every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("__last"))
            .select(*[F.col(f.name) if f.name in keys else F.col(f"__last.{f.name}").alias(f.name) for f in schema]))


def _writer(sdf: DataFrame, output_mode: str, target: str, checkpoint: str, keys: Sequence[str]):
    """A stream writer into ``target``, and its epochs' batches written whole."""
    writer = sdf.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if output_mode == "append":
        return writer.format("parquet").option("path", target)
    if output_mode not in ("complete", "update"):
        raise ValueError("table sink supports 'complete', 'update' and 'append' output")
    if output_mode == "update" and not keys:
        raise ValueError("update output needs the keys of a result row")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch_id}")
        files = Files(spark, target)
        before = int(files.read(POINTER)) if files.exists(POINTER) else None
        files.replace(POINTER, str(epoch_id))
        if output_mode == "complete" and before is not None and before < epoch_id:
            files.delete(f"epoch={before - KEPT_EPOCHS}")

    return writer.foreachBatch(write_batch)


@dataclass
class StreamReport:
    """What a run read and lost, summed over all its micro-batches."""

    #: Rows that the sources delivered.
    input_rows: int = 0
    #: Late rows as Spark counts them, which is after a task has folded its rows by key and window.
    dropped_by_watermark: int = 0
    #: The event time before which rows are late, as the last micro-batch left it.
    watermark: str | None = None
    batches: int = 0


class _Progress(StreamingQueryListener):
    """Adds up the progress of the queries of a session, by run.  (A query's own
    list keeps its last hundred micro-batches only.)"""

    def __init__(self):
        self.reports: dict[str, StreamReport] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _of(self, run: str) -> tuple[StreamReport, threading.Event]:
        with self.lock:
            return self.reports.setdefault(run, StreamReport()), self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event):
        self._of(str(event.runId))

    def onQueryProgress(self, event):
        progress = event.progress
        report, _ = self._of(str(progress.runId))
        report.input_rows += progress.numInputRows
        report.dropped_by_watermark += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        report.watermark = (progress.eventTime or {}).get("watermark", report.watermark)
        report.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._of(str(event.runId))[1].set()

    def report(self, run: str, timeout_s: float = 60.0) -> StreamReport:
        """The report of an ended run, when all its progress has arrived."""
        report, ended = self._of(run)
        if not ended.wait(timeout_s):
            raise TimeoutError("the progress of the stream did not arrive")
        return report


def _wait(query, name: str, timeout_s: float | None) -> None:
    query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {query.exception()}")


def run_stream_reported(sdf: DataFrame, name: str, output_mode: str = "complete", sink: str = "table",
                        path: str | None = None, checkpoint: str | None = None, timeout_s: float | None = None,
                        keys: Sequence[str] = ()) -> tuple[DataFrame, StreamReport]:
    """``run_stream`` with what the run read and lost."""
    if sink not in ("table", "memory"):
        raise ValueError("sink must be 'table' or 'memory'")
    spark = sdf.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    target = None if sink == "memory" else path or scratch_path(spark, name)
    if sink == "memory":
        writer = sdf.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).format("memory").queryName(name)
    else:
        writer = _writer(sdf, output_mode, target, ckpt, keys)
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        query = writer.trigger(availableNow=True).start()
        _wait(query, name, timeout_s)
        report = progress.report(str(query.runId))
    finally:
        spark.streams.removeListener(progress)
    if target is not None:
        result_table(spark, target, sdf.schema, output_mode, keys).createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {name}"), report


def run_stream(sdf: DataFrame, name: str, output_mode: str = "complete", sink: str = "table",
               path: str | None = None, checkpoint: str | None = None,
               timeout_s: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Drain every file present now (``availableNow``) and return ``SELECT *
    FROM <name>``.

    sink ``table``: results land as Parquet under the shared checkpoint folder.
        ``append`` uses the file sink's exactly-once log.  ``update`` (the form
        for data that grows) writes only the rows that a micro-batch changed,
        into a folder of its own, and the table is the latest row of each
        ``keys``.  ``complete`` writes the whole result into a folder of its
        own for each micro-batch.  A pointer file then moves to the folder in
        one step, so the table is always a whole epoch; of a complete result
        the one before stays for readers that began earlier.  A replayed
        micro-batch overwrites its own folder.
    sink ``memory``: the notebooks' in-driver table; fine for tests, not for
        results that grow with the data.

    The table is what ``path`` holds, not what this call wrote: with the same
    ``path`` and ``checkpoint``, a run without new input returns the earlier
    result.  A stream that never had input gives an empty table.  Any failure
    to read a result that was written is raised.
    """
    return run_stream_reported(sdf, name, output_mode, sink, path, checkpoint, timeout_s, keys)[0]


class RunningTable:
    """A stream that runs, and its result so far."""

    def __init__(self, query, spark: SparkSession, name: str, target: str, schema: T.StructType, output_mode: str, keys: Sequence[str]):
        self.query, self.name, self.target = query, name, target
        self._spark, self._schema, self._mode, self._keys = spark, schema, output_mode, keys

    def read(self) -> DataFrame:
        """The result as of the last whole epoch; also the view ``<name>``."""
        if self.query.exception() is not None:
            raise RuntimeError(f"stream {self.name} failed: {self.query.exception()}")
        table = result_table(self._spark, self.target, self._schema, self._mode, self._keys)
        table.createOrReplaceTempView(self.name)
        return table

    def catch_up(self) -> RunningTable:
        """Wait until all input that is there now has been taken in."""
        self.query.processAllAvailable()
        return self

    def stop(self) -> None:
        self.query.stop()
        self.query.awaitTermination()

    def __enter__(self) -> RunningTable:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


def follow_stream(sdf: DataFrame, name: str, output_mode: str = "complete", path: str | None = None,
                  checkpoint: str | None = None, keys: Sequence[str] = (), interval: str = "0 seconds") -> RunningTable:
    """Start a stream that keeps running (a micro-batch every ``interval``) and
    hand out its result while it does.  Started again with the same ``path`` and
    ``checkpoint`` it goes on, and its result is there at once."""
    spark = sdf.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    target = path or scratch_path(spark, name)
    query = _writer(sdf, output_mode, target, ckpt, keys).trigger(processingTime=interval).start()
    return RunningTable(query, spark, name, target, sdf.schema, output_mode, keys)
