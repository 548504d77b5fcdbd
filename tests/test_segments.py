"""The result cache as a log of segments: crashes, readers, writers, merging and the change feed."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cache as C
from graphloom.sources import segments
from graphloom.sources.changes import cache_changes
from graphloom.sources.tables import CACHE_SCHEMA, CacheTable

NAMES = ", ".join(c for c in CACHE_SCHEMA.split(", ") if not c.startswith("seq"))


def row(key, fn="f", h="h", at="2024", model="m"):
    return (key, fn, "{}", h, "c", model, "e", "p", "t", at)


def frame(spark, rows):
    return spark.createDataFrame(rows, NAMES)


def keys(df):
    return sorted(r.cache_key for r in df.select("cache_key").collect())


def test_a_crash_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    cache = CacheTable(spark, str(tmp_path))
    assert cache.read().count() == 0 and cache.version() == 0 and not os.listdir(tmp_path)
    cache.write(frame(spark, [row("a"), row("b", "g")]))

    def lost(self, manifest):
        raise OSError("the driver died")

    for name in ("_commit", "_store"):
        with monkeypatch.context() as m:
            m.setattr(segments.SegmentLog, name, lost if name == "_commit" else lambda self, rows, number: lost(self, None))
            with pytest.raises(OSError, match="died"):
                cache.write(frame(spark, [row("c", "h")]))
        assert keys(CacheTable(spark, str(tmp_path)).read()) == ["a", "b"]
    assert len(os.listdir(tmp_path / "segments")) == 2  # one that no manifest names
    cache.write(frame(spark, [row("c", "h")]))
    assert keys(cache.read()) == ["a", "b", "c"]
    assert cache.log.vacuum(0) == 1 and keys(cache.read()) == ["a", "b", "c"]


def test_a_reader_keeps_what_it_opened(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path))
    cache.write(frame(spark, [row("a"), row("b", "g")]))
    before = cache.read()
    cache.write(frame(spark, [row("a2", at="2025")]))
    cache.compact()
    assert keys(before) == ["a", "b"] and keys(cache.read()) == ["a2", "b"]
    assert keys(cache.read(1)) == ["a", "b"]
    cache.compact(retention=0)
    assert keys(cache.read()) == ["a2", "b"] and len(os.listdir(tmp_path / "segments")) == 1 and len([x for x in os.listdir(tmp_path / "manifests") if x[0] != "."]) == 1


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = CacheTable(spark, str(tmp_path)), CacheTable(spark, str(tmp_path))
    one.write(frame(spark, [row("a")]))
    commit, told = segments.SegmentLog._commit, []

    def slow(self, manifest):
        if self is one.log and not told:
            told.append(1)
            two.write(frame(spark, [row("b", at="2025"), row("x", "g")]))  # between the segment and the manifest of the other
        return commit(self, manifest)

    monkeypatch.setattr(segments.SegmentLog, "_commit", slow)
    one.write(frame(spark, [row("c", at="2026"), row("y", "h")]))
    got = {r.cache_key: r.seq for r in one.read().collect()}
    assert sorted(got) == ["c", "x", "y"] and len(set(got.values())) == 3 and got["c"] > 2  # what the other one wrote was superseded in turn
    monkeypatch.setattr(segments.SegmentLog, "_commit", lambda self, m: False)
    with pytest.raises(segments.ConflictError):
        one.write(frame(spark, [row("d")]))


def test_writers_at_the_same_time(spark, tmp_path):
    errors = []

    def work(k):
        try:
            own = CacheTable(spark, str(tmp_path))
            for i in range(3):
                own.write(frame(spark, [row(f"k{k}-{i}", f"f{k}-{i}")]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = CacheTable(spark, str(tmp_path)).read().collect()
    assert not errors and len(rows) == 9 and sorted(r.seq for r in rows) == list(range(1, 10))


def test_the_log_equals_a_table_rewritten_whole(spark, tmp_path):
    """Random writes with and without eviction, rewritten and deleted keys, purges and merges, against the operators on a plain table."""
    import random

    rng, cache = random.Random(4), CacheTable(spark, str(tmp_path))
    plain = spark.createDataFrame([], CACHE_SCHEMA)
    merged = 0
    for i in range(14):
        fns = rng.sample(range(8), rng.randint(1, 4))
        rows = [row(f"k{fn}-{rng.randint(0, 2)}", f"f{fn}", at=f"{2000 + rng.randint(0, 9)}") for fn in fns]
        evict = rng.random() < 0.7
        cache.write(frame(spark, rows), evict)
        last = max([r.seq for r in plain.collect()] + [cache.log.manifest(v).seq for v in cache.log.versions()[:-1]], default=0)
        order = sorted(rows, key=lambda r: (r[-1], r[0]))
        seqs = spark.createDataFrame([(*r, r_seq) for r_seq, r in enumerate(order, cache.log.manifest().seq - len(rows) + 1)], CACHE_SCHEMA)
        assert cache.log.manifest().seq >= last
        plain = C.evicting_write(plain, seqs) if evict else C.upsert(plain, seqs)
        if i % 5 == 4:
            plain, n = C.purge(plain)
            assert cache.purge() == n.first().purged
        if i == 10:
            cache.log.compact()
        plain = spark.createDataFrame(plain.collect(), CACHE_SCHEMA)
        assert sorted(cache.read().collect()) == sorted(plain.collect())
        merged = max(merged, len(cache.log.manifest().segments))
    assert merged <= segments.FAN


def test_a_write_costs_what_it_writes(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path))
    many = spark.range(20_000).select(*[F.concat(F.lit(c.split()[0]), F.sha2(F.col("id").cast("string"), 256)).alias(c.split()[0]) for c in NAMES.split(", ")])
    cache.write(many)
    cache.write(frame(spark, [row("a"), row("b", "g")]))
    big, small = cache.log.manifest().segments
    assert big.rows == 20_000 and small.rows == 2 and small.bytes < big.bytes / 100
    plan = cache.read().filter("fn_id = 'f'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(fn_id,f)") >= 1  # reaches the scan of the large segment


def test_changes_reach_another_session_once(spark, tmp_path):
    folder, out, at = str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    cache, other = CacheTable(spark, folder), spark.newSession()

    def follow():
        q = cache_changes(other, folder).select("cache_key", "deleted", "version").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(600)
        return sorted((r.version, r.deleted, r.cache_key) for r in spark.read.parquet(out).collect())

    cache.write(frame(spark, [row("a"), row("b", "g")]))
    assert follow() == [(1, False, "a"), (1, False, "b")]
    cache.write(frame(spark, [row("a2", at="2025")]))
    for i in range(7):
        cache.write(frame(spark, [row(f"c{i}", f"x{i}")]))  # the segments are merged meanwhile, which adds nothing
    want = [(1, False, "a"), (1, False, "b"), (2, False, "a2"), (2, True, "a")] + [(3 + i, False, f"c{i}") for i in range(6)]
    got = follow()
    assert got[: len(want)] == want and len(got) == len(want) + 1
    assert follow() == got
    cache.compact(retention=0)
    cache.write(frame(spark, [row("z", "zz")]))
    late = cache_changes(other, folder).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="retention"):
        late.awaitTermination(600)
