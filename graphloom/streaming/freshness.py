"""One state machine for the freshness of functions over a stream of changes, by file; operators.change has its batch form.

State is the greatest seq of each kind of event, by function, and a file's saves that are not settled yet. Only maxima
are kept, so that events may come in any order and more than once. Timers in event time debounce saves and ask for a
flush of what is dirty at each tick.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.storage import ship

#: kind: 'state' (a function's state after seq), 'reindex' (a file's saves settled: n of them, seq the last), 'flush' (a dirty function at a tick, seq its edit).
OUT = "file string, fn string, kind string, state string, seq long, n long, at timestamp"
_KINDS = ("edit", "flush", "regenerate", "stale")


class Machine(StatefulProcessor):
    """Rows of one file at a time; see freshness_stream."""

    def __init__(self, gap_ms: int, tick_ms: int) -> None:
        self.gap_ms, self.tick_ms = gap_ms, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.functions = handle.getMapState("functions", "fn string", ", ".join(f"{k} long" for k in _KINDS))
        self.saved = handle.getValueState("saved", "seq long")
        self.waiting = handle.getListState("waiting", "us long, seq long")

    def _saved(self) -> int:
        return self.saved.get()[0] if self.saved.exists() else -1

    def _state(self, seqs: tuple, saved: int) -> str:
        edit, flush, regenerate, stale = seqs
        return "dirty" if edit > max(flush, regenerate, saved) else "stale" if stale > regenerate else "fresh"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        out: list[tuple] = []
        before, newest = self._saved(), int(frame["seq"].max())
        saves = frame[frame["kind"] == "save"]
        saved = max(before, int(saves["seq"].max())) if len(saves) else before
        if saved > before:
            self.saved.update((saved,))
            for (fn,), seqs in list(self.functions.iterator()):  # a file's functions
                if self._state(tuple(seqs), before) != (now := self._state(tuple(seqs), saved)):
                    out.append((key[0], fn, "state", now, newest, 0, pd.NaT))
        own = frame[frame["kind"].isin(_KINDS) & frame["fn"].notna()]
        last: dict[str, dict[str, int]] = {}
        for fn, kind, seq in zip(own["fn"].tolist(), own["kind"].tolist(), own["seq"].tolist(), strict=True):  # a file's rows: plain loops cost less than frames of a few rows
            kinds = last.setdefault(fn, {})
            if seq == seq and seq > kinds.get(kind, -1):
                kinds[kind] = int(seq)
        for fn in sorted(last):
            old = tuple(self.functions.getValue((fn,))) if self.functions.containsKey((fn,)) else (-1,) * len(_KINDS)
            new = tuple(max(a, last[fn].get(k, -1)) for a, k in zip(old, _KINDS, strict=True))
            if new != old:
                self.functions.updateValue((fn,), new)
            out.append((key[0], fn, "state", self._state(new, saved), newest, 0, pd.NaT))
        due = {int(us) // 1000 + self.gap_ms + 1 for us in saves["us"]}
        if len(saves):
            self.waiting.appendList([(int(us), int(seq)) for us, seq in zip(saves["us"], saves["seq"], strict=True)])
        due |= {(int(us) // 1000 // self.tick_ms + 1) * self.tick_ms for us in own.loc[own["kind"] == "edit", "us"]}
        for at in due:
            self.handle.registerTimer(at)
        yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        times = sorted({tuple(x) for x in self.waiting.get()}) if self.waiting.exists() else []  # a save that came twice counts once
        run, kept = [], []
        for i, (us, seq) in enumerate(times):
            run.append((us, seq))
            if i + 1 == len(times) or times[i + 1][0] - us > self.gap_ms * 1000:  # the run ends here
                if us + self.gap_ms * 1000 <= at * 1000:
                    out.append((key[0], None, "reindex", None, max(s for _, s in run), len(run), pd.Timestamp(us + self.gap_ms * 1000, unit="us")))
                else:
                    kept += run
                run = []
        if len(kept) < len(times):
            self.waiting.put(kept) if kept else self.waiting.clear()
        if at % self.tick_ms == 0:
            saved = self._saved()
            dirty = [(fn, seqs[0]) for (fn,), seqs in self.functions.iterator() if self._state(tuple(seqs), saved) == "dirty"]
            out += [(key[0], fn, "flush", "dirty", seq, 0, pd.Timestamp(at, unit="ms")) for fn, seq in dirty]
            if dirty:  # until a later event clears it
                self.handle.registerTimer(at + self.tick_ms)
        yield self._rows(out)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype({"seq": "int64", "n": "int64", "at": "datetime64[us]", "file": object, "fn": object, "kind": object, "state": object})

    def close(self) -> None:
        pass


def with_stale(changes: DataFrame, context: DataFrame) -> DataFrame:
    """changes(seq, ts, file, fn, kind, changed) and a 'stale' event of the same seq for each neighbour of a regenerated function that changed.

    context(file, fn, r_file, r_fn): the capped callers and callees of each function. Works alike on streams and tables.
    """
    names = ["seq", "ts", "file", "fn", "kind"]
    near = context.select(F.col("file").alias("c_file"), F.col("fn").alias("c_fn"), "r_file", "r_fn")
    hit = changes.filter("kind = 'regenerate' AND changed").join(near, (F.col("file") == F.col("c_file")) & (F.col("fn") == F.col("c_fn")))
    return changes.select(*names).unionByName(hit.select("seq", "ts", F.col("r_file").alias("file"), F.col("r_fn").alias("fn"), F.lit("stale").alias("kind")))


def freshness_stream(changes: DataFrame, gap_seconds: float, tick_seconds: float, late: str) -> DataFrame:
    """(OUT) over a stream of changes(seq, ts, file, fn, kind); kinds: edit, save, flush, regenerate, stale.

    A function is dirty if its last edit is later than its last flush or regeneration and its file's last save; else
    stale if it was made stale after its last regeneration; else fresh. A row of kind 'state' tells a function's state
    whenever a batch touches it. Saves of a file that are no more than gap_seconds apart settle into one 'reindex', a
    gap after the last. At each tick of tick_seconds the dirty functions are asked to be 'flush'ed, until they are.
    late: how far behind the latest event time rows may come. Start it within state_store().
    """
    ship(changes.sparkSession)
    rows = changes.withWatermark("ts", late).select("seq", "ts", "file", "fn", "kind", F.unix_micros("ts").alias("us"))
    return rows.groupBy("file").transformWithStateInPandas(Machine(int(gap_seconds * 1000), int(tick_seconds * 1000)), OUT, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within have the state store that maps and timers need; a query keeps the one it started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def last_states(out: DataFrame) -> DataFrame:
    """(file, fn, state): the last state of each function among the rows (OUT) that a stream wrote, batch by batch (gl_batch)."""
    return out.filter("kind = 'state'").groupBy("file", "fn").agg(F.max_by("state", "gl_batch").alias("state"))

