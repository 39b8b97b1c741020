"""Streams: repeated log lines, job progress, catalogs and tags kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import tags as tag_jobs
from ..sources.versions import Table
from ..storage import shared_folder

WINDOW_MS = 1500
#: Times of a line that wait together: some minutes, a million at most.
SPAN_MS = 1 << 20
MAX_TEXT = 12_000
CUT = "… [truncated]"


def arriving(table: DataFrame) -> DataFrame:
    """The files of a table, and those that come later, as a stream; a table of one file may lie beside others."""
    files = table.inputFiles()
    folders, names = {f.rpartition("/")[0] for f in files}, {f.rpartition("/")[2] for f in files}
    stream = table.sparkSession.readStream.schema(table.schema)
    if len(names) == 1:
        stream = stream.option("pathGlobFilter", names.pop())
    return stream.parquet(*folders)


def finished(spark: SparkSession, writer: DataStreamWriter, checkpoint: str | None = None) -> None:
    """Runs a stream's writer over all that has arrived, with its checkpoint in the shared folder."""
    writer.option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()


class Closing:
    """A second source beside a stream that comes to an end: one row that moves the watermark past all others."""

    def __init__(self, stream: DataFrame, column: str) -> None:
        self.spark, self.schema, self.column = stream.sparkSession, stream.schema, column
        self.folder = f"{shared_folder(self.spark)}/closing-{uuid.uuid4().hex}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        self.stream = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def put(self) -> None:
        row = [F.lit("2250-01-01 00:00:00" if f.name == self.column else None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def drained(stream: DataFrame, name: str, closing: Closing | None = None) -> DataFrame:
    """What a stream makes of all that has arrived, as a Parquet table in the shared folder.

    With ``closing``, whose stream this one is made of, what waits for the watermark comes out too.
    """
    spark = stream.sparkSession
    path, checkpoint = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    finished(spark, writer, checkpoint)
    if closing:
        closing.put()
        finished(spark, writer, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


def with_state(spark: SparkSession) -> None:
    """State with timers and time to live needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shortened(column: str = "message"):
    return F.when(F.length(column) > MAX_TEXT, F.concat(F.substring(column, 1, MAX_TEXT), F.lit(CUT))).otherwise(F.col(column))


def _kept(times, last):
    """Times that lie WINDOW_MS or more after the last one kept, and that last one."""
    out = []
    for t in times:
        if last is None or t - last >= WINDOW_MS:
            out.append(t)
            last = t
    return out, last


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by level, message and ms; a line that goes on in the next batch keeps its last time."""
    now, last = (), None
    for batch in batches:
        out = []
        for line, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[:2]):
            now, last = line, last if line == now else None
            kept, last = _kept((ms for *_, ms in rows), last)
            out += [(*line, ms) for ms in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["level", "message", "ms"])


def dedupe_logs_batch(logs: DataFrame) -> DataFrame:
    """level, message and ts of lines that weren't kept within 1.5 s before; sorted rows pass as a stream, no line's times are held at once."""
    rows = logs.select("level", shortened().alias("message"), F.unix_millis("ts").alias("ms"))
    rows = rows.repartition("level", "message").sortWithinPartitions("level", "message", "ms")
    return rows.mapInArrow(_scan_lines, "level string, message string, ms long").select("level", "message", F.timestamp_millis("ms").alias("ts"))


class _Lines(StatefulProcessor):
    """Keeps a line's times until the watermark has passed them, so they are judged in order whatever file they came in.

    Times wait in spans of SPAN_MS, packed, so the state is called for each span of a batch, not for each row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "times binary")
        self.last = handle.getValueState("last", "ms long")

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _times(self, span: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((span,))[0], np.int32) + span * SPAN_MS

    def _put(self, span: int, times: np.ndarray) -> None:
        self.waiting.updateValue((span,), ((times - span * SPAN_MS).astype(np.int32).tobytes(),))

    def _add(self, found: list[np.ndarray]) -> None:
        times = np.unique(np.concatenate(found))
        spans, first = np.unique(times // SPAN_MS, return_index=True)
        for span, some in zip(spans.tolist(), np.split(times, first[1:]), strict=True):
            self._put(span, np.union1d(self._times(span), some) if self.waiting.containsKey((span,)) else some)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, n, least = [], 0, min(self.handle.listTimers(), default=None)
        for batch in rows:
            times = np.unique(batch["ms"].astype("int64").to_numpy())
            found, n, least = [*found, times], n + len(times), min(int(times[0]), int(times[0]) if least is None else least)
            if n >= 1 << 20:
                self._add(found)
                found, n = [], 0
        if found:
            self._add(found)
        self._wake(least)
        yield _line_rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Judges the times that no later row can come before; what is left of a line goes when nothing can depend on it."""
        passed = timerValues.getCurrentWatermarkInMs()
        last, left = self.last.get()[0] if self.last.exists() else None, None
        for span in sorted(k[0] for k in self.waiting.keys()):
            times = self._times(span)
            n = int(np.searchsorted(times, passed, side="right"))
            kept, last = _kept_of(times[:n], last)
            if n:
                yield _line_rows(key, kept)
            if n < len(times):
                left = int(times[n])
                if n:
                    self._put(span, times[n:])
                break
            self.waiting.removeKey((span,))
        if left is not None:
            self.last.update((last,)) if last is not None else None
            self._wake(left)
        elif last is not None and last + WINDOW_MS > passed:
            self.last.update((last,))
            self._wake(last + WINDOW_MS)
        else:
            self.last.clear()
        yield _line_rows(key, [])

    def close(self) -> None:
        pass


def _kept_of(times: np.ndarray, last: int | None) -> tuple[list[int], int | None]:
    """As _kept, of sorted times: from one kept to the next by search."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + WINDOW_MS))
    while at < len(times):
        last = int(times[at])
        out.append(last)
        at = int(np.searchsorted(times, last + WINDOW_MS))
    return out, last


def _line_rows(key: tuple, kept: list[int]) -> pd.DataFrame:
    text = lambda v: pd.Series([v] * len(kept), dtype=object)  # noqa: E731  pandas' own text type may come in chunks, which Spark doesn't take
    return pd.DataFrame({"level": text(key[0]), "message": text(key[1]), "ms": pd.Series(kept, dtype="int64")})


def dedupe_logs(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """As dedupe_logs_batch, over a stream, for rows that come no later than ``late``; later ones are dropped.

    A line comes out when the watermark has passed it; ``drained`` moves it past the last one.
    """
    with_state(stream.sparkSession)
    rows = stream.withWatermark("ts", late).select("level", shortened().alias("message"), "ts", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("level", "message").transformWithStateInPandas(_Lines(), "level string, message string, ms long", "Append", "EventTime")
    return out.select("level", "message", F.timestamp_millis("ms").alias("ts"))


def _progress(events: Iterable[tuple[int, str, int]], total: int, done: int) -> tuple[list[tuple[int, int]], int, int]:
    out = []
    for at, kind, n in events:
        total, done = (total + n, done) if kind == "add" else (total, done + n)
        if total and done >= total:
            out.append((at, done))
            total = done = 0
    return out, total, done


def _scan_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by job and time; a job that goes on in the next batch keeps its counts."""
    now, total, done = (), 0, 0
    for batch in batches:
        found = []
        for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[:1]):
            if key != now:
                now, total, done = key, 0, 0
            out, total, done = _progress((r[1:] for r in rows), total, done)
            found += [(*key, *x) for x in out]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["job_id", "at", "completed"])


def job_progress_batch(events: DataFrame) -> DataFrame:
    """job_id, at and completed: each time that as many are done as were added; counting then starts anew."""
    rows = events.select(F.col("job_id").cast("long").alias("job_id"), F.col("at").cast("long").alias("at"), "kind", F.col("n").cast("long").alias("n"))
    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "kind", "n").mapInArrow(_scan_jobs, "job_id long, at long, completed long")


class _Jobs(StatefulProcessor):
    """Counts of jobs that are under way; a job's state goes when it ends, or ``ttl_ms`` after its last event."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, done long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, done = self.counts.get() if self.counts.exists() else (0, 0)
        events = sorted((int(a), k, int(n)) for b in rows for a, k, n in zip(b["at"], b["kind"], b["n"], strict=True))
        out, total, done = _progress(events, int(total), int(done))
        if total or done:
            self.counts.update((total, done))
        else:
            self.counts.clear()
        yield pd.DataFrame({"job_id": pd.Series([key[0]] * len(out), dtype=object), "at": pd.Series([a for a, _ in out], dtype="int64"), "completed": pd.Series([c for _, c in out], dtype="int64")})

    def close(self) -> None:
        pass


def job_progress(stream: DataFrame, ttl_ms: int | None = 7 * 24 * 3600 * 1000) -> DataFrame:
    """As job_progress_batch, over a stream whose batches are in order.

    With a time to live a stream has batches without data for ever, so one that is to end takes None; its
    jobs then leave state only until they end.
    """
    with_state(stream.sparkSession)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy("job_id").transformWithStateInPandas(_Jobs(ttl_ms), "job_id long, at long, completed long", "Append", mode)


def newest(rows: DataFrame, key: str = "path") -> DataFrame:
    """One row a key: the latest, by modified; ties by a hash of the row.  Summed by task before it is shuffled."""
    latest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct("modified", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))
    return rows.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def upsert(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Newer rows replace older ones; late older ones are ignored."""
    return newest(current.unionByName(changes), key)


def incremental_catalog(stream: DataFrame, table: Table, name: str = "catalog"):
    """A writer that merges new and changed rows into the catalog table: only the buckets they are in are rewritten.

    ``name`` stands for the stream in the table's manifest: a batch that comes again after a restart changes
    nothing.  A stream with a new checkpoint counts anew and needs a new name.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = newest(batch, table.key).persist()
        try:
            if table.manifest() is None:
                table.replace(rows, name, number)
            else:
                table.merge(rows, lambda known, new: upsert(known, new, table.key), name, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge)


def incremental_tags(stream: DataFrame, table: Table, name: str = "tags"):
    """A writer that adds a tagger's tags (path, tags) to photos of the catalog table that have none of its kind."""

    def merge(batch: DataFrame, number: int) -> None:
        found = batch.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")).persist()
        try:
            table.merge(found, tag_jobs.merge_ai_tags, name, number)
        finally:
            found.unpersist()

    return stream.writeStream.foreachBatch(merge)
