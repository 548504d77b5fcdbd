"""Streaming twins against their batch forms."""

from __future__ import annotations

from graphloom.operators import change as C
from graphloom.streaming import state as S

CHANGES = "seq long, file string, fn string, kind string"


def test_dirty_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", "f", "edit"), (2, "a", "g", "edit"), (3, "b", "h", "edit"), (4, "a", "f", "flush"), (5, "b", None, "save"), (6, "b", "k", "edit"), (7, "c", "z", "edit")]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last: dict[str, str] = {}

    def keep(batch, _):
        last.update({r.file: r.dirty for r in batch.collect()})

    q = S.dirty_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.file, r.fn) for r in C.dirty_functions(spark.createDataFrame(rows, CHANGES)).collect()}
    assert {(f, x) for f, d in last.items() for x in d.split(",") if x} == batch == {("a", "g"), ("b", "k"), ("c", "z")}


def test_debounce_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT k, timestamp_seconds(t) AS ts FROM VALUES ('a', 0), ('a', 1), ('a', 5), ('b', 2), ('z', 1000) AS v(k, t)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.debounce_stream(stream, "k", "ts", "2 seconds", "1 second").writeStream.format("memory").queryName("fired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, int(r.fired_at.timestamp()), r.triggers) for r in spark.table("fired").collect())
    want = sorted((r.k, r.fired_at_us // 1_000_000, r.triggers) for r in C.debounce(df, "k", "ts", 2).collect() if r.k != "z")
    assert got == want == [("a", 3, 2), ("a", 7, 1), ("b", 4, 1)]


def wait_for(condition, seconds=40):
    import time

    end = time.monotonic() + seconds
    while not condition() and time.monotonic() < end:
        time.sleep(0.1)
    assert condition()


def test_saves_fold_into_one_run_a_file_and_batch(spark, tmp_path):
    done = []
    (tmp_path / "in").mkdir()
    saves = spark.readStream.schema("file string").json(str(tmp_path / "in"))
    (tmp_path / "in" / "1.json").write_text('{"file": "a"}\n{"file": "a"}\n{"file": "b"}\n')
    q = S.reindex_on_save(saves, done.extend, str(tmp_path / "cp"), 0.2)
    wait_for(lambda: sorted(done) == ["a", "b"])
    (tmp_path / "in" / "2.json").write_text('{"file": "a"}\n{"file": "a"}\n')
    wait_for(lambda: sorted(done) == ["a", "a", "b"])
    q.stop()
    again = S.reindex_on_save(saves, done.extend, str(tmp_path / "cp"), 0.2)  # a restart does not run old saves again
    (tmp_path / "in" / "3.json").write_text('{"file": "c"}\n')
    wait_for(lambda: "c" in done)
    again.stop()
    assert sorted(done) == ["a", "a", "b", "c"]


def test_markers_wait_while_a_pass_runs(spark, tmp_path):
    import threading

    done, busy = [], threading.Event()
    busy.set()
    (tmp_path / "marks").mkdir()
    markers = S.marker_stream(spark, str(tmp_path / "marks"))
    (tmp_path / "marks" / "m1").write_text("a.py\n notes.txt\nweb/b.tsx \na.py\n")
    q = S.reindex_on_markers(markers, done.extend, busy.is_set, str(tmp_path / "cp"), 0.1)
    import time

    time.sleep(2)
    assert done == []
    busy.clear()
    wait_for(lambda: sorted(done) == ["a.py", "web/b.tsx"])
    q.stop()


def test_flush_seconds_and_ticks(spark, tmp_path):
    assert [S.flush_seconds(x) for x in (None, 4, 5, 60)] == [25, 25, 5, 60]
    rows = [(1, "a", "f", "edit"), (2, "b", "g", "edit"), (3, "b", None, "save")]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in")), {}
    q = S.flush_ticks(S.dirty_stream(stream), lambda batch, i: seen.update({r.file: r.n for r in batch.collect()}), 5, str(tmp_path / "cp"))
    wait_for(lambda: seen == {"a": 1, "b": 0})
    q.stop()


def test_background_work_waits_for_interactive_work(spark):
    import threading
    import time

    order, p = [], S.Priority(spark, grace=0.3)
    inside, go = threading.Event(), threading.Event()

    def interactive():
        with p.interactive():
            inside.set()
            go.wait(10)
            order.append("interactive")

    def background():
        with p.background():
            order.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))

    threads = [threading.Thread(target=interactive)]
    threads[0].start()
    inside.wait(10)
    threads.append(threading.Thread(target=background))
    threads[1].start()
    time.sleep(0.2)
    assert order == []
    left = time.monotonic()
    go.set()
    for t in threads:
        t.join(10)
    assert order == ["interactive", "background"] and time.monotonic() - left >= 0.25
