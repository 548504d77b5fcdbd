"""The state machine over a stream of shuffled events equals its batch form, across a restart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphloom.operators import change as C
from graphloom.streaming import freshness as S

SCHEMA = "seq long, ts timestamp, file string, fn string, kind string, changed boolean"
GAP, TICK = 20, 50


def events(n=400):
    import datetime

    rng, start = random.Random(11), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        kind = rng.choice(["edit"] * 5 + ["save"] * 2 + ["flush", "regenerate", "regenerate"])
        file = f"f{rng.randint(0, 5)}"
        rows.append((i, start + datetime.timedelta(seconds=3 * i + rng.random()), file, None if kind == "save" or i % 37 == 0 else f"{file}.{rng.randint(0, 6)}", kind, kind == "regenerate" and i % 3 > 0))
    return rows


def test_stream_equals_batch_on_shuffled_events_across_a_restart(spark, tmp_path):
    rows = events()
    context = spark.createDataFrame([(f"f{i}", f"f{i}.{k}", f"f{(i + 1) % 6}", f"f{(i + 1) % 6}.{(k + j) % 7}") for i in range(6) for k in range(7) for j in (1, 3)], "file string, fn string, r_file string, r_fn string")
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    end = (10_000, rows[-1][1].replace(year=2025), "end", None, "save", False)
    (tmp_path / "in").mkdir()

    def put(name, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def follow():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = S.freshness_stream(S.with_stale(stream, context), GAP, TICK, "2 hours")
        write = lambda batch, i: batch.withColumn("gl_batch", F.lit(i)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={i}"))
        with S.state_store(spark):
            q = out.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    put("a", shuffled[:150])
    put("b", shuffled[150:260])
    follow()
    put("c", shuffled[260:] + shuffled[:40])  # some come twice
    put("d", [end])
    follow()
    got = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in C.freshness(S.with_stale(table, context)).collect()}
    assert {tuple(r) for r in S.last_states(got).collect()} == want and {s for _, _, s in want} == {"dirty", "stale", "fresh"}
    saves = spark.createDataFrame([r for r in rows + shuffled[:40] if r[4] == "save"], SCHEMA)
    runs = {(r.file, r.fired_at_us): r.triggers for r in C.debounce(saves.dropDuplicates(["seq"]), "file", "ts", GAP).collect()}
    fired = [(r.file, r.us) for r in got.filter("kind = 'reindex'").select("file", F.unix_micros("at").alias("us")).collect()]
    assert sorted(fired) == sorted(runs) and len(set(fired)) == len(fired)  # each run fires once, though rows repeat
    flushed = {(r.file, r.fn) for r in got.filter("kind = 'flush'").select("file", "fn").collect()}
    assert {(f, fn) for f, fn, s in want if s == "dirty"} <= flushed


def test_batch_form_by_hand(spark):
    rows = [(1, "a", "x", "edit"), (2, "a", "y", "edit"), (3, "a", "x", "flush"), (4, "a", "y", "stale"), (5, "a", None, "save"), (6, "a", "x", "stale"), (7, "a", "x", "regenerate"), (8, "b", "z", "edit"), (9, "b", "z", "stale"), (10, "a", None, "edit")]
    got = {(r.file, r.fn): r.state for r in C.freshness(spark.createDataFrame(rows, "seq long, file string, fn string, kind string")).collect()}
    assert got == {("a", "x"): "fresh", ("a", "y"): "stale", ("b", "z"): "dirty"}
