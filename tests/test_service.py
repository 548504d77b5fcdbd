"""The façade over a small tree."""

from __future__ import annotations

import pytest

from graphloom.functions import generation
from graphloom.service import CodeMap


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.py").write_text("def top():\n    return mid() + 1\n\n\ndef mid():\n    return low()\n")
    (root / "b.py").write_text("def low():\n    return 1\n\n\ndef alone():\n    pass\n")
    return CodeMap(spark, str(root)).index()


def test_requests(code):
    assert code.status() == {"functions": 4, "edges": 2}
    assert code.list_ranked_functions().first().name == "low"
    nodes, _, _ = code.call("get_blast_radius", rel_fname="b.py", name="low", line=3)
    assert {(r.name, r.depth) for r in nodes.collect()} == {("mid", 1), ("top", 2)}
    steps, _ = code.get_call_trace("a.py", "top", 0)
    assert [r.callee_name for r in steps.orderBy("depth").collect()] == ["mid", "low"]
    assert code.resolve_function("mid").first().found and not code.resolve_function("nope").first().found
    assert {(r.name, r.direction, r.r_name) for r in code.index_file("b.py").collect()} == {("low", "caller", "mid")}
    with pytest.raises(ValueError, match="unknown method"):
        code.call("drop_everything")


def test_generation(code):
    rows = {r.name: r.explanation for r in code.generate_explanations().collect()}
    assert set(rows) == {"top", "mid", "low", "alone"} and rows["mid"].role_tag == "utility"
    made_up = '{"role_tag": "x", "one_liner": "y.", "why_it_exists": "z", "used_by": ["top", "ghost"], "calls": ["low"], "side_effects": [], "risk_note": null}'
    e = {r.name: r.explanation for r in code.generate_explanations(lambda p: made_up).collect()}
    assert e["mid"].used_by == ["top"] and e["mid"].calls == ["low"] and e["alone"].used_by == []
    with pytest.raises(Exception, match="division by zero"):  # a fault of the program, not of the model
        code.generate_explanations(lambda p: 1 / 0).collect()

    def missing(prompt):
        raise generation.GenerationError.of(404, "m", "not found")

    report = generation.acceptance_report(code.generate_explanations(missing)).collect()
    assert all(not r.passed and r.issues == ["no valid answer"] and "pull it first" in r.error for r in report)
    assert code.generate_file_summary().count() == 2


def test_a_slow_model_is_an_error_of_the_row(spark):
    from pyspark.sql import functions as F

    def slow(prompt):
        import time

        time.sleep(1.5 if prompt == "b" else 0)
        return prompt.upper() + "{tail"

    rows = spark.createDataFrame([("a",), ("b",), (None,)], "p string").coalesce(1).select("p", generation.generate(F.col("p"), slow, ("{",), timeout=0.5).alias("g")).collect()
    got = {r.p: tuple(r.g) for r in rows}
    assert got["a"] == ("A", None) and got[None] == (None, None) and got["b"] == (None, "no answer within 0.5 seconds")


def test_a_model_behind_http():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            status = 404 if body["model"] == "absent" else 500 if body["model"] == "broken" else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"response": "said"} if status == 200 else {"error": "no"}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/generate"
    assert generation.HttpModel(url, "m", stop=("{",), schema={"type": "object"})("hello") == "said"
    assert asked[0]["options"] == {"temperature": 0, "stop": ["{"]} and asked[0]["format"] == {"type": "object"} and asked[0]["prompt"] == "hello"
    for name, said in (("absent", "pull it first"), ("broken", "answered 500")):
        with pytest.raises(generation.GenerationError, match=said):
            generation.HttpModel(url, name)("x")
    server.shutdown()
    server.server_close()
    with pytest.raises(generation.GenerationError, match="cannot be reached"):
        generation.HttpModel(url, "m", timeout=1)("x")


def test_one_explanation_and_requests_that_fail(code):
    row = code.generate_explanation("a.py", "mid", 5, "def mid(): ...").first()
    assert row.context_tier == "call_graph_only" and row.explanation.role_tag == "utility" and len(row.context_hash) == 64
    nowhere = code.call("generate_explanation", rel_fname="x.py", name="x", line=3, fn_source="x").first()
    assert nowhere.context_hash != row.context_hash

    def down(prompt):
        raise generation.GenerationError.of(None, "m", "refused")

    with pytest.raises(generation.GenerationError, match="cannot be reached"):
        code.generate_explanation("a.py", "mid", 5, "x", model=down)
    assert code.dispatch({"id": 4, "method": "nope"}) == {"id": 4, "error": {"message": "unknown method: nope"}}
    answer = code.dispatch({"id": 5, "method": "generate_explanation", "params": {"rel_fname": "a.py", "name": "mid", "line": 5, "fn_source": "x", "model": down}})
    assert answer["id"] == 5 and answer["error"]["message"].startswith("GenerationError: ")
    assert code.dispatch({"id": 6, "method": "status"})["result"]["functions"] == 4
    dump = [r.text for r in code.dump().orderBy("pos").collect()]
    assert len(dump) == 4 and dump[0].startswith("b.py:1 low()  importance=") and "callers (1): a.py:mid" in dump[0]


def stored(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    return 2\n")
    (root / "b.py").write_text("def two_again(n):\n    return 2 * n\n")
    return CodeMap(spark, str(root), store=str(tmp_path / "store")).index(embed=True), tmp_path


@pytest.fixture
def alone(spark, tmp_path):
    return stored(spark, tmp_path)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """One store for the tests below, in their order: its cache is empty at first, and the last one empties its vectors."""
    return stored(spark, tmp_path_factory.mktemp("kept"))


def counting(folder):
    def model(prompt):
        import uuid

        (folder / uuid.uuid4().hex).touch()
        return generation.stub(prompt)

    folder.mkdir()
    return model


def test_a_second_pass_generates_nothing(spark, alone):
    from pathlib import Path

    code, tmp = alone
    model = counting(tmp / "calls")
    calls = lambda: len(list((tmp / "calls").iterdir()))
    assert {r.outcome for r in code.index_pass(None, model, "m").collect()} == {"generated"}
    assert calls() == 6  # three functions, two stages
    assert {r.outcome for r in code.index_pass(None, model, "m").collect()} == {"skipped"} and calls() == 6
    assert all(r.context_tier == "call_graph_and_retrieval" for r in code.cache.read().collect())
    Path(code.root, "b.py").write_text("def two_again(n):\n    return 3 * n\n")
    code.reindex_file("b.py", embed=True)
    got = {r.fn_id: r.outcome for r in code.index_pass(None, model, "m").collect()}
    assert got == {"a.py::one": "skipped", "a.py::two": "skipped", "b.py::two_again": "generated"} and calls() == 8
    assert code.cache.read().count() == 3  # the superseded row went
    marks = spark.createDataFrame([("a.py::one",), ("a.py::two",)], "fn_id string")
    outcomes, dirty, stale = code.refresh("a.py", "one", 0, marks, marks.limit(0), model, "m")
    assert [r.outcome for r in outcomes.collect()] == ["generated"] and calls() == 10
    assert [r.fn_id for r in dirty.collect()] == ["a.py::two"] and code.cache.read().count() == 3
    assert code.write_pages(str(tmp / "wiki"), model=lambda p: " Purpose. More. ", model_id="m") == 4
    index, page = (tmp / "wiki" / "index.md").read_text(), (tmp / "wiki" / "a.py.md").read_text()
    assert "From 3 explained function(s) across 2 file(s)." in index and "[b.py](b.py.md) — Purpose." in index
    assert page.startswith("# a.py\n\nPurpose. More.\n\n## Functions") and "### one (utility)" in page
    assert "| two | [a.py:5](a.py.md) | utility |" in (tmp / "wiki" / "functions.md").read_text()
    root = code.generate_cluster_summary("a.py", "two", 4, lambda p: p, "m").first()
    assert "one (depth 1, utility)" in root.summary and root.error is None


def test_commands_over_the_cache(kept):
    code, _ = kept
    assert code.search().count() == 0
    assert {(r.fn_id, r.outcome) for r in code.prioritize_file("a.py").collect()} == {("a.py::one", "generated"), ("a.py::two", "generated")}
    assert [r.label for r in code.search().collect()] == ["one", "two"] and [r.label for r in code.search("tw").collect()] == ["two"]
    assert code.search("zzz").count() == 0
    top = code.most_important(2).collect()
    assert top[0]["name"] == "two" and top[0].detail.startswith("utility — ") and len(top) == 2
    near = code.show_blast_radius("a.py", "two", 4).collect()
    assert [(r["name"], r.depth, r.role_tag) for r in near] == [("one", 1, "utility")]
    assert code.purge_cache() == 0


def test_a_failing_embedder_costs_the_retrieval_only(kept, monkeypatch):
    code, _ = kept

    def down(texts):
        raise generation.GenerationError.of(None, "emb", "refused")

    monkeypatch.setattr(code, "embedder", down)
    with pytest.warns(UserWarning, match="retrieval failed"):
        row = code.generate_explanation("a.py", "two", 4, "def two(): ...").first()
    assert row.context_tier == "call_graph_only" and row.explanation.role_tag == "utility"
    monkeypatch.setattr(code, "embedder", lambda texts: texts[0].no_such_thing)
    with pytest.raises(Exception, match="no_such_thing"):
        code.generate_explanation("a.py", "two", 4, "def two(): ...")


def test_retrieval_changes_the_context_hash(kept):
    code, _ = kept
    with_chunks = code.generate_explanation("a.py", "two", 4, "def two(): ...").first()
    assert with_chunks.context_tier == "call_graph_and_retrieval"
    assert code.vectors.replace_all(code.vectors.read().limit(0)) == 0 and not code.vectors.exists()
    without = code.generate_explanation("a.py", "two", 4, "def two(): ...").first()
    assert without.context_tier == "call_graph_only" and without.context_hash != with_chunks.context_hash


def test_acceptance_report(code):
    report, missing = code.acceptance_report(["mid", "nobody"])
    text = report.first().text
    assert "- Functions: 1\n- Passed: 1 of 1" in text and "## `mid`, a.py:4 [passed]" in text and "**Callers:** top" in text
    assert [r["name"] for r in missing.collect()] == ["nobody"]
    report, missing = code.acceptance_report(limit=2, model=lambda p: "nothing")
    assert report.first().text.count("no valid answer") == 2 and missing.count() == 0


def test_tables(spark, tmp_path):
    from graphloom.sources.tables import CacheTable, VectorTable

    store = VectorTable(spark, str(tmp_path))
    assert store.read().count() == 0 and store.file("a").count() == 0
    rows = spark.createDataFrame([(f"f{i % 7}", i, i + 1, f"it's {i}", [float(i)]) for i in range(70)], "rel_fname string, start_line int, end_line int, text string, vector array<float>")
    assert store.replace_all(rows) == 70 and store.file("f3").count() == 10
    assert store.replace_file("f3", rows.filter("start_line = 3")) == 1 and store.read().count() == 61
    assert store.replace_file("f3", rows.limit(0)) == 0 and store.read().count() == 60
    assert store.replace_file("it's new", rows.filter("start_line = 1").selectExpr("'it\\'s new' AS rel_fname", "start_line", "end_line", "text", "vector")) == 1
    assert store.file("it's new").count() == 1 and store.read().count() == 61
    cache = CacheTable(spark, str(tmp_path / "cache"))
    row = lambda key, h, at: (key, "f", "{}", h, "c", "m", "e", "p", "t", at)
    names = "cache_key string, fn_id string, explanation_json string, fn_hash string, context_hash string, model_id string, embedding_model_id string, prompt_version string, context_tier string, generated_at string"
    cache.write(spark.createDataFrame([row("k1", "h1", "2024")], names), evict=False)
    cache.write(spark.createDataFrame([row("k2", "h2", "2025")], names), evict=False)
    assert cache.read().count() == 2 and cache.purge() == 1 and cache.purge() == 0
    cache.write(spark.createDataFrame([row("k3", "h3", "2026")], names))
    assert [r.cache_key for r in CacheTable(spark, str(tmp_path / "cache")).read().collect()] == ["k3"]


def test_digest_and_reindex(code, tmp_path):
    text = code.generate_digest().first().text
    assert (code.generate_digest().first().total_files, code.generate_digest().first().truncated) == (2, False)
    assert "2 of 2 file(s) included." in text and "├── a.py\n└── b.py" in text
    from pathlib import Path

    Path(code.root, "b.py").write_text("def low():\n    return top()\n")
    assert code.reindex_file("b.py") == 1
    assert code.status() == {"functions": 3, "edges": 3}


def test_text_of_any_bytes(spark, tmp_path):
    """Latin-1 source, a bad byte late in a file, files that cannot be read and large binaries: all else goes on, and offsets agree with slices."""
    from graphloom.sources import tree

    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("def ok():\n    return caf\u00e9()\n")
    (root / "b.js").write_bytes("// \xe9\xe8 \xff\nfunction cafex() { return ok(); }\nfunction after(\xe9) { return ok('\xe9'); }\n".encode("latin-1"))
    (root / "late.txt").write_bytes(b"x" * 1500 + b"\xff" + b"y" * 500)
    (root / "bin.dat").write_bytes(b"\0" * 200_000)
    (root / "nul.txt").write_bytes(b"a\0b")
    code = CodeMap(spark, str(root)).index()
    assert code.status() == {"functions": 3, "edges": 2}
    sources = {r.name: r.fn_source for r in code.functions().collect()}
    assert sources["ok"] == "def ok():\n    return caf\u00e9()" and sources["after"].startswith("function after(\ufffd)") and sources["after"].endswith("}")
    got = code.generate_digest().first()
    assert (got.total_files, got.included_files) == (5, 2) and "x" * 1500 + "\ufffd" + "y" * 500 in got.text
    assert "bin.dat (too-large, 200000 bytes)" in got.text and "nul.txt (binary, 3 bytes)" in got.text
    gone = tree.with_content(spark.createDataFrame([("a.py",), ("gone.py",)], "rel_fname string"), str(root))
    assert {r.rel_fname: (r.content is None, r.error is None) for r in gone.collect()} == {"a.py": (False, True), "gone.py": (True, False)}
    (root / "c.py").symlink_to(root / "loop")
    (root / "loop").symlink_to(root / "c.py")
    code.reindex_files(["c.py"])
    assert code.status()["functions"] == 3 and [r.rel_fname for r in code.unreadable.collect()] == ["c.py"]


def test_a_reindex_reads_the_named_files_alone_and_leaves_no_tables(spark, tmp_path):
    from pathlib import Path

    from graphloom.storage import shared_dir

    root = tmp_path / "code"
    (root / "node_modules").mkdir(parents=True)
    for name, callee in (("a", "b"), ("b", "c"), ("c", "a")):
        (root / f"{name}.py").write_text(f"def {name}():\n    return {callee}()\n")
    code = CodeMap(spark, str(root)).index()
    tables = lambda: {p.name for p in Path(shared_dir(spark), "graphloom").iterdir()}
    (root / "a.py").unlink()
    (root / "b.py").write_text("def b():\n    return c()\n\n\ndef d():\n    return b()\n")
    (root / "node_modules" / "x.py").write_text("def no(): pass\n")
    (root / "new.py").write_text("def new():\n    return d()\n")
    assert code.reindex_files(["b.py", "new.py", "node_modules/x.py", "notes.txt"]) == 3
    assert code.status() == {"functions": 5, "edges": 5}  # a.py was not looked at
    kept, _, _ = code.get_blast_radius("b.py", "d", 4)
    assert code.reindex_files(["a.py"]) == 0 and code.status() == {"functions": 4, "edges": 3}
    assert [r.name for r in kept.collect()] == ["new"]  # asked before the index was renewed
    code.reindex_files(["c.py"])
    before = tables()
    for _ in range(3):
        code.reindex_files(["b.py", "c.py"])
    assert len(tables() - before) == len(before - tables())
    code.close()
    assert not tables() & before - tables() and len(tables()) < len(before)
