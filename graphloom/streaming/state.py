"""Streaming twins of the change-tracking operators; the batch forms in operators.change say what they mean."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources import tree


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """A row a key and session (window end = firing time), once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("triggers")).select(key, F.col("session.end").alias("fired_at"), "triggers")


def dirty_stream(changes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Running dirty set of each file over changes(seq, file, fn, kind): a row (file, dirty, n) whenever a batch touches the file.

    State is a file's marked functions with the seq of their mark, so that a batch may arrive in any order within
    itself. idle_ms: a file that nothing touches for so long is forgotten (never, by default).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        marks = pd.Series(dict(zip(*state.get, strict=True)), dtype="int64") if state.exists else pd.Series(dtype="int64")
        rows = pd.concat(list(frames))
        saved = rows.loc[rows["kind"] == "save", "seq"].max()
        if pd.notna(saved):
            marks, rows = marks.iloc[:0], rows[rows["seq"] > saved]
        last = rows[rows["kind"].isin(("edit", "flush")) & rows["fn"].notna()].sort_values("seq").groupby("fn").last()
        marks = marks.drop(last.index, errors="ignore")
        marks = pd.concat([marks, last.loc[last["kind"] == "edit", "seq"].astype("int64")])
        state.update((marks.index.tolist(), [int(x) for x in marks]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"file": [key[0]], "dirty": [",".join(sorted(marks.index))], "n": [len(marks)]})

    return changes.groupBy("file").applyInPandasWithState(step, "file string, dirty string, n long", "fns array<string>, seqs array<long>", "update", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def _started(stream: DataFrame, handle: Callable[[DataFrame, int], None], seconds: float, checkpoint: str | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def reindex_on_save(saves: DataFrame, reindex: Callable[[list[str]], int], checkpoint: str | None = None, seconds: float = 0.75) -> StreamingQuery:
    """Run reindex over the files of each micro-batch of saves(file), once; batches are serial, so saves during a run fold into exactly one rerun.

    checkpoint: a folder that makes a restarted stream go on where it ended; a batch that failed is run again.
    """

    def handle(batch: DataFrame, _: int) -> None:
        files = sorted(r.file for r in batch.select("file").distinct().collect())  # the files saved within one trigger
        if files:
            reindex(files)

    return _started(saves, handle, seconds, checkpoint)


#: Seconds between flushes, by default and at least.
FLUSH_SECONDS, LEAST_FLUSH_SECONDS = 25, 5


def flush_seconds(wanted: float | None) -> float:
    return wanted if wanted is not None and wanted >= LEAST_FLUSH_SECONDS else FLUSH_SECONDS


def flush_ticks(dirty: DataFrame, handle: Callable[[DataFrame, int], None], seconds: float | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Periodic flush of dirty_stream(); a tick never overlaps the one before, and a handler that fails gets its batch again after a restart."""
    return _started(dirty, handle, flush_seconds(seconds), checkpoint, "update")


def marker_stream(spark, folder: str, extensions: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Changed files named in marker files as they arrive, one marker a micro-batch; lines of unsupported extensions are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    path = F.trim("value")
    if extensions is None:
        return lines.filter(tree.supported(path)).select(path.alias("rel_fname"))
    keep = F.lit(False)
    for e in extensions:
        keep = keep | F.endswith(path, F.lit(e))
    return lines.filter(keep).select(path.alias("rel_fname"))


def reindex_on_markers(markers: DataFrame, reindex: Callable[[list[str]], int], busy: Callable[[], bool], checkpoint: str | None = None, seconds: float = 0.3) -> StreamingQuery:
    """Run reindex once over the files of each marker. While busy() holds, as during a background pass, no marker is consumed: the batch waits."""

    def handle(batch: DataFrame, _: int) -> None:
        while busy():
            time.sleep(seconds)
        files = sorted(r.rel_fname for r in batch.select("rel_fname").distinct().collect())  # the lines of one marker
        if files:
            reindex(files)

    return _started(markers, handle, seconds, checkpoint)


class Priority:
    """Interactive work before background work: each has a pool of the FAIR scheduler, and background steps wait for interactive ones.

    The session needs spark.scheduler.mode=FAIR for the pools to share executors; the waiting holds in any mode.
    """

    def __init__(self, spark, grace: float = 0.3) -> None:  # noqa: ANN001
        self.spark, self.grace, self.pending, self.quiet = spark, grace, 0, 0.0
        self.changed = threading.Condition()

    @contextmanager
    def interactive(self) -> Iterator[None]:
        with self.changed:
            self.pending += 1
        try:
            with self._pool("interactive"):
                yield
        finally:
            with self.changed:
                self.pending -= 1
                self.quiet = time.monotonic()
                self.changed.notify_all()

    @contextmanager
    def background(self) -> Iterator[None]:
        """Entered once no interactive work has been pending for the grace time."""
        with self.changed:
            while self.pending or (left := self.grace - (time.monotonic() - self.quiet)) > 0:
                self.changed.wait(None if self.pending else left)
        with self._pool("background"):
            yield

    @contextmanager
    def _pool(self, name: str) -> Iterator[None]:
        context = self.spark.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            yield
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)
