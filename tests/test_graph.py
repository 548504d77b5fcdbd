"""Call-graph semantics on small hand-made graphs."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from graphloom.operators import graph as G

TAGS = "rel_fname string, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, tag_seq int"
ALIASES = "rel_fname string, name string, target_name string"
EDGES = "caller_file string, caller_name string, caller_line int, callee_file string, callee_name string, callee_line int, weight long, confident boolean"
IMPORTANCE = "rel_fname string, name string, line int, importance double"


def d(f, n, line, s, e, seq=0):
    return (f, n, "def", line, line, s, e, seq)


def r(f, n, s, e):
    return (f, n, "ref", 0, 0, s, e, 99)


def edges_of(spark, tags, aliases=()):
    g = G.call_graph(spark.createDataFrame(tags, TAGS), spark.createDataFrame(list(aliases), ALIASES))
    return {(x.caller_name, x.callee_file, x.callee_name): (x.weight, x.confident) for x in g.collect()}


def test_innermost_definition_takes_the_reference(spark):
    tags = [d("a", "outer", 1, 0, 100), d("a", "inner", 2, 10, 50), d("a", "f", 9, 200, 210), r("a", "f", 20, 25), r("a", "f", 60, 65), r("a", "f", 300, 305)]
    assert edges_of(spark, tags) == {("inner", "a", "f"): (1, True), ("outer", "a", "f"): (1, True)}


def test_ambiguous_names_are_sure_only_in_their_own_file(spark):
    tags = [d("a", "m", 1, 0, 100), d("a", "f", 9, 200, 210), d("b", "f", 1, 0, 10), d("c", "n", 1, 0, 50), r("a", "f", 5, 9), r("c", "f", 5, 9), r("c", "f", 15, 19)]
    got = edges_of(spark, tags)
    assert got == {("m", "a", "f"): (1, True), ("m", "b", "f"): (1, False), ("n", "a", "f"): (2, False), ("n", "b", "f"): (2, False)}


def test_two_tags_of_one_node_count_twice(spark):
    tags = [d("a", "f", 1, 0, 50, 0), d("a", "f", 1, 5, 50, 1), d("b", "m", 1, 0, 50), r("b", "f", 5, 9)]
    assert edges_of(spark, tags) == {("m", "a", "f"): (2, False)}


def test_aliases_add_candidates_once_and_do_not_chain(spark):
    tags = [d("a", "f", 1, 0, 9), d("b", "m", 1, 0, 50), r("b", "F", 5, 9), r("b", "FF", 15, 19)]
    aliases = [("x", "F", "f"), ("y", "F", "f"), ("y", "FF", "F")]
    assert edges_of(spark, tags, aliases) == {("m", "a", "f"): (1, True)}


def test_recursion_stays(spark):
    assert edges_of(spark, [d("a", "f", 1, 0, 50), r("a", "f", 5, 9)]) == {("f", "a", "f"): (1, True)}


def graph(spark, pairs, importance=()):
    names = sorted({x for p in pairs for x in p})
    e = spark.createDataFrame([("f", a, 1, "f", b, 1, 1, True) for a, b in pairs], EDGES)
    given = dict(importance)
    return e, spark.createDataFrame([("f", n, 1, given.get(n, 1.0)) for n in names], IMPORTANCE), spark.createDataFrame([("f", n, 1) for n in names], "rel_fname string, name string, line int")


def root(spark, name):
    return spark.createDataFrame([(1, "f", name, 1)], "root long, rel_fname string, name string, line int")


def test_pagerank_sums_to_one_and_prefers_the_called(spark):
    e, _, n = graph(spark, [("a", "c"), ("b", "c"), ("c", "a")])
    x = {v.name: v.importance for v in G.pagerank(n, e).collect()}
    assert sum(x.values()) == pytest.approx(1, abs=1e-6)
    assert x["c"] > x["a"] > x["b"]


def test_blast_radius_converges_and_ends_on_cycles(spark):
    e, imp, _ = graph(spark, [("A", "R"), ("B", "R"), ("A", "B"), ("C", "A"), ("D", "A"), ("R", "C")])
    nodes, edges, omitted = G.blast_radius(e, imp, root(spark, "R"))
    assert {(x.name, x.depth) for x in nodes.collect()} == {("A", 1), ("B", 1), ("C", 2), ("D", 2)}
    assert {(x.caller_name, x.callee_name) for x in edges.collect()} >= {("A", "B"), ("R", "C")}
    assert omitted.count() == 0


def test_wide_level_is_capped_and_the_rest_never_returns(spark):
    pairs = [(f"c{i:02}", "R") for i in range(17)] + [("c16", "c00")]
    e, imp, _ = graph(spark, pairs, [(f"c{i:02}", 100.0 - i) for i in range(17)])
    nodes, _, omitted = G.blast_radius(e, imp, root(spark, "R"))
    assert {x.name for x in nodes.collect()} == {f"c{i:02}" for i in range(15)}
    assert [(x.depth, x.omitted_count) for x in omitted.collect()] == [(1, 2)]


def test_trace_stops_where_it_closes_a_loop(spark):
    e, imp, _ = graph(spark, [("A", "B"), ("B", "A"), ("B", "C")], [("A", 9.0)])
    steps, branches = G.call_trace(e, imp, root(spark, "A"))
    assert [(x.depth, x.callee_name, x.loops) for x in steps.orderBy("depth").collect()] == [(1, "B", False), (2, "A", True)]
    assert branches.count() == 0


def test_trace_lists_alternates(spark):
    e, imp, _ = graph(spark, [("A", f"c{i:02}") for i in range(20)])
    steps, branches = G.call_trace(e, imp, root(spark, "A"))
    assert steps.count() == 1
    got = branches.collect()
    assert len(got) == 15 and {x.omitted for x in got} == {4}


@pytest.mark.parametrize("few", [100_000, 0])  # edges told apart, or one fold of all
def test_incremental_equals_full(spark, few, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_EDGES", few)
    old = [d("a", "f", 1, 0, 9), d("b", "m", 1, 0, 50), r("b", "f", 5, 9), r("b", "F", 15, 19), d("c", "f", 1, 0, 9)]
    new = [*old[:4], d("c", "g", 1, 0, 9)]
    al = spark.createDataFrame([("a", "F", "f")], ALIASES)
    o, n = spark.createDataFrame(old, TAGS), spark.createDataFrame(new, TAGS)
    got = G.update_call_graph(G.call_graph(o, al), G.contributions(G.enclosed_refs(o), G.candidates(o, al)), o, n, al, "c")
    key = lambda x: tuple(x[c] for c in sorted(x.asDict()))
    assert sorted(map(key, got.collect())) == sorted(map(key, G.call_graph(n, al).collect()))


def test_dyadic_ranges_cover_each_number_once(spark):
    rows = [(a, b) for a in (0, 1, 2, 3, 5, 8, 13, 31, 64) for b in (a, a + 1, a + 2, a + 7, a + 100)] + [(0, 2**40), (3, 2**40 + 5), (9, 4)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", G.dyadic(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        parts = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.d or [])
        assert len(parts) <= 2 * max(1, (max(1, r.b - r.a + 1)).bit_length())
        if r.b >= r.a:
            assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
            assert all(sum(x.level == k for x in r.d) <= 2 for k in {x.level for x in r.d})
        else:
            assert not parts


def test_intervals_of_any_length_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    spans = [("f", i, s, s + rng.choice([0, 3, 50, 5000, 10**6])) for i, s in enumerate(rng.randint(0, 20_000) for _ in range(150))] + [("f", 999, 0, 2**40), ("g", 1, 5, 6)]
    points = sorted({("f", p, p + rng.choice([0, 2, 90])) for p in (rng.randint(0, 30_000) for _ in range(300))} | {("g", 5, 5), ("g", 7, 7), ("h", 1, 1), ("f", 2**40, 2**40)})
    S = spark.createDataFrame(spans, "file string, seq long, s long, e long")
    P = spark.createDataFrame(points, "file string, a long, b long")
    got = {(r.file, r.a, r.b): r.found.seq for r in G.innermost(P, S, "file", ("a", "b"), ("s", "e"), "seq", 32).collect()}
    want = {}
    for f, a, b in points:
        held = [(e - s, q) for g, q, s, e in spans if g == f and s <= a and b <= e]
        if held:
            want[f, a, b] = min(held)[1]
    assert got == want
    got = {(r.file, r.a): r.found.seq for r in G.outermost(P.select("file", "a").distinct(), S, "file", "a", ("s", "e"), "seq", 32).collect()}
    assert got == {(f, a): min((s, q) for g, q, s, e in spans if g == f and s <= a <= e)[1] for f, a, _ in points if any(g == f and s <= a <= e for g, _, s, e in spans)}


def test_rank_by_names_equals_the_rank_over_edges(spark):
    import random

    rng = random.Random(5)
    tags = []
    for i in range(60):
        f, name = f"f{i % 5}", "hot" if i % 3 == 0 else f"n{i % 25}"
        tags.append((f, name, "def", i, i, 100 * i, 100 * i + 99, i))
        tags += [(f, rng.choice(["hot", "also", f"n{rng.randint(0, 30)}"]), "ref", i, i, 100 * i + 5 + k, 100 * i + 6 + k, 1000 + 10 * i + k) for k in range(rng.randint(0, 5))]
    t = spark.createDataFrame(tags, "rel_fname string, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, tag_seq int")
    a = spark.createDataFrame([("f0", "also", "hot"), ("f1", "n3", "n4")], "rel_fname string, name string, target_name string")
    nodes, refs, found, edges = G.nodes(t), G.enclosed_refs(t), G.candidates(t, a), G.call_graph(t, a)
    key = lambda df: {(r.rel_fname, r.name, r.line): r.importance for r in df.collect()}
    over_edges, by_names = key(G.pagerank(nodes, edges)), key(G.pagerank_by_names(nodes, refs, found))
    assert over_edges.keys() == by_names.keys() and max(abs(v - by_names[k]) for k, v in over_edges.items()) < 1e-9
    assert key(G.fan_in(nodes, edges)) == key(G.fan_in_by_names(nodes, refs, found))
    sure = edges.filter("confident").select(*G.CALLER, *G.CALLEE).collect()
    assert sorted(sure) == sorted(G.confident_edges(refs, found).collect()) and sure


def test_rank_after_an_update_starts_from_the_rank_before(spark, monkeypatch):
    import random

    rng = random.Random(9)
    n = 300
    nodes = spark.createDataFrame([("f", f"n{i}", i) for i in range(n)], "rel_fname string, name string, line int")
    links = {(rng.randint(0, n - 1), rng.randint(0, n - 1)): rng.randint(1, 3) for _ in range(900)}
    frame = lambda d: spark.createDataFrame([("f", f"n{a}", a, "f", f"n{b}", b, w) for (a, b), w in d.items()], "caller_file string, caller_name string, caller_line int, callee_file string, callee_name string, callee_line int, weight long")
    before = G.cut(G.pagerank(nodes, frame(links)), "before")
    more = links | {(0, 5): 7, (17, 250): 2}
    grown = nodes.union(spark.createDataFrame([("f", "new", 999)], nodes.schema))
    steps, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, label, *a: (steps.append(label), cut(df, label, *a))[1])
    full = {r.name: r.importance for r in G.pagerank(grown, frame(more)).collect()}
    cold, _ = steps.count("rank-x"), steps.clear()
    warm = {r.name: r.importance for r in G.pagerank(grown, frame(more), start=before).collect()}
    assert steps.count("rank-x") < cold
    bound = 2 * 0.85 / 0.15 * 301 * 1e-6
    assert warm.keys() == full.keys() and sum(abs(v - warm[k]) for k, v in full.items()) <= bound and abs(sum(warm.values()) - 1) < 1e-9


def test_nearest_definition_in_a_hot_name_pairs_nothing(spark):
    import random

    rng = random.Random(2)
    defs = [("f", "hot", rng.randint(0, 500), q) for q in range(120)] + [("f", "hot", 70, 900), ("f", "hot", 70, 1), (None, "hot", 3, 5), ("g", "one", 9, 1)]
    probes = sorted({(i, "f", "hot", rng.randint(-20, 520)) for i in range(150)}) + [(900, "f", "gone", 3), (901, "g", "one", 100)]
    P = spark.createDataFrame([*probes, probes[0], (902, "f", "hot", None), (903, None, "hot", 3)], "probe long, rel_fname string, name string, at_line long")
    D = spark.createDataFrame(defs, "rel_fname string, name string, start_line long, tag_seq long")
    out = G.nearest_def(P, D)
    got = {r.probe: r.line for r in out.collect()}
    want = {p: min(((abs(line - at), q, line) for f, n, line, q in defs if (f, n) == (file, name)), default=(0, 0, None))[2] for p, file, name, at in probes}
    assert got == {**want, 902: None, 903: None}
    assert out.count() == len(got) and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
