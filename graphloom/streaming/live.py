"""A tree that is kept fresh: edits and saves come as a stream of events, saves reindex and regenerate, ticks flush what is dirty."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import graph as G
from graphloom.operators import passes
from graphloom.storage import Scratch, cut
from graphloom.streaming import freshness
from graphloom.streaming.state import FLUSH_SECONDS

if TYPE_CHECKING:
    from graphloom.service import CodeMap

#: Events: fn is a fn_id, file a rel_fname; see freshness.freshness_stream for the kinds.
CHANGES = "seq long, ts timestamp, file string, fn string, kind string"
#: Fixed value: seconds without a save after which a file's saves are settled.
SAVE_SECONDS = 0.75


class Live:
    """The loop over a CodeMap with a store. What a pass finds (regenerated, unchanged, vanished, stale) goes back into the stream as events.

    A batch of the stream that fails, or whose driver is lost, runs again: passes skip what is cached, and events count
    once however often they come.
    """

    def __init__(self, code: CodeMap, folder: str, gap_seconds: float = SAVE_SECONDS, tick_seconds: float = FLUSH_SECONDS, late: str = "10 seconds", model_id: str = "stub", **options: object) -> None:
        """options: of passes.generate_rows (model, reason, timeout)."""
        self.code, self.folder, self.gap, self.tick, self.late, self.model_id, self.options = code, folder.rstrip("/"), gap_seconds, tick_seconds, late, model_id, options
        self.spark = code.spark

    def put(self, events: DataFrame, name: str | None = None) -> None:
        """Add events (CHANGES); ts may be left out: now."""
        rows = events if "ts" in events.columns else events.withColumn("ts", F.current_timestamp())
        rows.select(*(c.split()[0] for c in CHANGES.split(", "))).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/changes/{name or uuid.uuid4().hex}")

    def start(self, **trigger: object) -> StreamingQuery:
        """trigger: of DataStreamWriter.trigger, every half second by default."""
        changes = self.spark.readStream.schema(CHANGES).parquet(f"{self.folder}/changes/*")
        out = freshness.freshness_stream(changes, self.gap, self.tick, self.late)
        with freshness.state_store(self.spark):
            return out.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()

    def states(self) -> DataFrame:
        """(file, fn, state): the last known state of each function."""
        return freshness.last_states(self.spark.read.parquet(f"{self.folder}/states").withColumnRenamed("batch", "gl_batch"))

    def _step(self, batch: DataFrame, number: int) -> None:
        with Scratch() as working:
            rows = cut(batch, "live")
            rows.filter("kind = 'state'").write.mode("overwrite").parquet(f"{self.folder}/states/batch={number}")
            told = [self._save(rows.filter("kind = 'reindex'")), self._flush(rows.filter("kind = 'flush'"))]
            for kind, events in zip(("saves", "flushes"), told, strict=True):
                if events is not None:
                    self.put(events, f"{kind}-{number:09d}")
        working.free()

    def _context(self) -> DataFrame:
        return G.function_context(self.code.edges, self.code.importance)

    def _stale(self, stale: DataFrame) -> DataFrame:
        ids = self.code.functions().select(*passes.NODE, "fn_id")
        return stale.join(ids, passes.NODE).select(F.col("rel_fname").alias("file"), "fn_id")

    def _save(self, settled: DataFrame) -> DataFrame | None:
        """Reindex the files whose saves have settled, all at once, and explain what changed in them."""
        seqs = {r.file: r.seq for r in settled.groupBy("file").agg(F.max("seq").alias("seq")).collect()}  # the files saved meanwhile
        if not seqs:
            return None
        self.code.reindex_files(sorted(seqs), embed=self.code.vectors is not None and self.code.vectors.exists())
        own = self.code.functions().filter(F.col("rel_fname").isin(*seqs))
        targets = cut(self.code.targets(own, self.model_id), "saved")
        outcomes, stale = passes.save_pass(self.code.cache, targets, self._context(), **self.options)
        files = settled.groupBy("file").agg(F.max("seq").alias("seq"))
        seen = targets.select("fn_id", F.col("rel_fname").alias("file")).join(files, "file")
        outcomes = outcomes.withColumn("outcome", F.when(F.col("outcome") == "skipped", "unchanged").otherwise(F.col("outcome")))
        return passes.events_of(outcomes, self._stale(stale), seen)

    def _flush(self, asked: DataFrame) -> DataFrame | None:
        """Explain the functions that are dirty at a tick from what their files hold now."""
        files = [r.file for r in asked.select("file").distinct().collect()]  # those edited meanwhile
        if not files:
            return None
        self.code.reindex_files(sorted(files))
        seqs = asked.groupBy(F.col("fn").alias("fn_id"), "file").agg(F.max("seq").alias("seq"))
        own = self.code.functions().filter(F.col("rel_fname").isin(*files)).join(seqs.select("fn_id"), "fn_id", "left_semi")
        outcomes, stale = passes.flush_pass(self.code.cache, seqs, cut(self.code.targets(own, self.model_id), "dirty"), self._context(), **self.options)
        return passes.events_of(outcomes, self._stale(stale), seqs)
