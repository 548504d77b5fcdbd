"""Edits and saves of a small tree, kept fresh by the stream."""

from __future__ import annotations

import datetime
import json
import time

from graphloom.functions import generation
from graphloom.service import CodeMap
from graphloom.streaming.live import Live



def test_saves_and_flushes_keep_a_tree_fresh(spark, tmp_path):
    root, calls = tmp_path / "code", tmp_path / "calls"
    root.mkdir(), calls.mkdir()
    (root / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    (root / "b.py").write_text("def three():\n    return one()\n\n\ndef broken():\n    return 0\n")
    code = CodeMap(spark, str(root), store=str(tmp_path / "store")).index()

    def model(prompt):
        import uuid

        (calls / uuid.uuid4().hex).touch()
        if "broken" in prompt.rpartition("Function source:")[2][:40] or "return 99" in prompt:
            raise generation.GenerationError("busy")
        return json.dumps({"role_tag": "t", "one_liner": "x", "why_it_exists": "y", "used_by": [], "calls": [], "side_effects": [], "risk_note": None})

    code.index_pass(None, model, "m")
    live = Live(code, str(tmp_path / "live"), gap_seconds=0.5, tick_seconds=2, late="1 second", model_id="m", model=model)

    def run(events):
        """Events of the last five seconds; those that passes told before are older."""
        time.sleep(7)
        at = lambda s: datetime.datetime.now(datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=s - 5)
        live.put(spark.createDataFrame([(seq, at(s), file, fn, kind) for seq, s, file, fn, kind in events], "seq long, ts timestamp, file string, fn string, kind string"))
        for _ in range(2):  # the second run takes what the passes of the first one told
            assert live.start(availableNow=True).awaitTermination(300)
        return {r.fn: r.state for r in live.states().filter("file <> 'clock'").collect()}

    before = len(list(calls.iterdir()))
    (root / "a.py").write_text("def one():\n    return two() + 1\n\n\ndef two():\n    return 2\n")
    got = run([(1, 0, "a.py", "a.py::one", "edit"), (2, 0.5, "a.py", None, "save"), (3, 0.8, "a.py", None, "save"), (4, 5, "clock", None, "save")])
    assert got == {"a.py::one": "fresh", "a.py::two": "stale", "b.py::three": "stale"}  # the neighbours of what changed
    assert len(list(calls.iterdir())) == before + 2  # one function in two stages, once for two saves
    assert {r.fn_id for r in code.cache.read().filter("fn_hash <> ''").collect()} >= {"a.py::one", "a.py::two", "b.py::three"}

    (root / "a.py").write_text("def one():\n    return two() + 1\n\n\ndef two():\n    return 99\n")  # which the model fails on
    got = run([(10, 0, "a.py", "a.py::two", "edit"), (11, 0, "a.py", "a.py::gone", "edit"), (12, 0.1, "a.py", "a.py::one", "edit"), (13, 5, "clock", None, "save")])
    assert got["a.py::two"] == "dirty" and got["a.py::gone"] == "fresh" and got["a.py::one"] == "fresh"  # failed, vanished, unchanged
    (root / "a.py").write_text("def one():\n    return two() + 1\n\n\ndef two():\n    return 3\n")
    got = run([(20, 5, "clock", None, "save")])  # the next ticks try again
    assert got["a.py::two"] == "fresh" and got["a.py::one"] == "stale"
