"""The background pass: pauses, faults of the program and lost drivers ask no model twice."""

from __future__ import annotations

import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import generation
from graphloom.operators import cache as C
from graphloom.operators import passes
from graphloom.sources.tables import CacheTable
from graphloom.streaming.background import BackgroundPass
from graphloom.streaming.state import Priority


def targets(spark, n):
    rows = spark.range(n).select(
        F.lit("a.py").alias("rel_fname"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").alias("line"), F.when(F.col("id") != 3, F.concat(F.lit("source "), F.col("id").cast("string"))).alias("fn_source"),
        F.concat(F.lit("a.py::f"), F.col("id").cast("string")).alias("fn_id"),
    )
    none = rows.limit(0).select("rel_fname", "name", "line", F.lit("").alias("direction"), F.lit(1).alias("pos"), F.lit("").alias("r_file"), F.lit("").alias("r_name"), F.lit(1).alias("r_line"), F.lit(0).cast("long").alias("omitted"))
    return passes.wanted(passes.with_context(rows, none), passes.Versions("m"))


def model(folder, broken=None):
    """Writes down each function that it is asked for; fails on 5, and does not return for those of `broken` that exist as files."""

    def ask(prompt):
        import re
        import uuid
        from pathlib import Path

        source = re.findall(r"source (\d+)", prompt)[-1]
        if broken and Path(broken, source).exists():
            raise OSError("a fault of the program")
        if source == "5":
            raise generation.GenerationError("busy")
        Path(folder, f"{source}-{uuid.uuid4().hex}").touch()
        return json.dumps({"role_tag": source, "one_liner": "x", "why_it_exists": "y", "used_by": [], "calls": [], "side_effects": [], "risk_note": None})

    folder.mkdir(exist_ok=True)
    return ask


def calls(folder):
    return Counter(int(p.name.partition("-")[0]) for p in folder.iterdir())


def test_a_pass_pauses_and_resumes_and_asks_nothing_twice(spark, tmp_path):
    cache, asked, broken = CacheTable(spark, str(tmp_path / "cache")), tmp_path / "asked", tmp_path / "broken"
    broken.mkdir()
    rows = targets(spark, 22)
    passes.index_pass(cache, rows.filter("line = 1"), model=model(asked))  # cached before
    first = calls(asked)
    work = BackgroundPass(spark, str(tmp_path / "pass"), cache, Priority(spark, 0.0), model=model(asked, str(broken)))
    assert work.plan(rows, ["line"], batch_rows=5) == 5
    assert work.counters().first().asDict() == {"total": 22, "generated": 0, "skipped": 0, "unresolved": 0, "failed": 0, "percent": 0}
    assert work.run(batches=2) is False  # it pauses itself
    assert work.counters().first().asDict() == {"total": 22, "generated": 7, "skipped": 1, "unresolved": 1, "failed": 1, "percent": 45}
    assert {r.fn_id for r in cache.read().collect()} == {f"a.py::f{i}" for i in range(10) if i not in (3, 5)}

    (broken / "12").touch()
    again = BackgroundPass(spark, str(tmp_path / "pass"), cache, model=model(asked, str(broken)))  # another session
    assert again.plan(rows, ["line"], batch_rows=5) == 5
    with pytest.raises(Exception, match="a fault of the program"):
        again.run()
    (broken / "12").unlink()
    before = calls(asked)
    assert again.run() is True and not again.running()
    assert again.counters().first().asDict() == {"total": 22, "generated": 19, "skipped": 1, "unresolved": 1, "failed": 1, "percent": 100}
    got = calls(asked)
    assert {k: n for k, n in got.items() if k < 10} == {k: n for k, n in before.items() if k < 10}  # two stages each
    assert set(got) == set(range(22)) - {3, 5} and got[1] == first[1] and all(n == 2 for k, n in got.items() if k < 10 or k > 14)
    assert again.run() is True and calls(asked) == got  # nothing is left
    assert again.rate().count() == 5 and again.rate().filter("batch = 4").first().rest == 0


def test_a_driver_lost_before_the_commit_asks_nothing_again(spark, tmp_path, monkeypatch):
    cache, asked = CacheTable(spark, str(tmp_path / "cache")), tmp_path / "asked"
    work = BackgroundPass(spark, str(tmp_path / "pass"), cache, model=model(asked))
    work.plan(targets(spark, 3), ["line"], batch_rows=5)

    def lost(self, *a, **b):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(CacheTable, "write", lost)
        with pytest.raises(Exception, match="the driver died"):
            work.run()
    assert cache.read().count() == 0 and calls(asked) == {0: 2, 1: 2, 2: 2}
    assert BackgroundPass(spark, str(tmp_path / "pass"), cache, model=model(asked)).run()
    assert cache.read().count() == 3 and calls(asked) == {0: 2, 1: 2, 2: 2}


def test_a_pause_from_another_session_waits_for_the_batch(spark, tmp_path):
    cache, gate = CacheTable(spark, str(tmp_path / "cache")), tmp_path / "gate"

    def slow(prompt):
        import time
        from pathlib import Path

        end = time.monotonic() + 60
        while not Path(gate).exists() and time.monotonic() < end:
            time.sleep(0.05)
        return generation.stub(prompt)

    work = BackgroundPass(spark, str(tmp_path / "pass"), cache, model=slow)
    work.plan(targets(spark, 3), ["line"], batch_rows=1)
    work.start()
    other = BackgroundPass(spark, str(tmp_path / "pass"), cache)
    threading.Timer(3, lambda: (other.pause(), gate.touch())).start()
    assert work.wait() is False
    assert cache.read().count() == 1 and other.counters().first().percent == 33
    assert C.current_rows(cache.read()).count() == 1
    assert work.run() and cache.read().count() == 3


def test_joins_of_a_pass_collect_no_table(spark):
    names = ["cache_key", "fn_id", "explanation_json", "fn_hash", "context_hash", "model_id", "embedding_model_id", "prompt_version", "context_tier", "generated_at"]
    cache = spark.range(9).selectExpr(*[f"CAST(id AS string) AS {n}" for n in names], "id AS seq")
    wanted, keys = cache.select("fn_id", "fn_hash", *C.VERSION), cache.select("cache_key")
    made = [C.cached(wanted, cache), C.uncached(wanted, cache), C.lookup(cache, wanted), C.evicted(cache, cache), C.delete(cache, keys), passes.save_outcomes(wanted, cache, wanted)]
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert [df.count() for df in made] == [9, 0, 9, 0, 0, 9]
