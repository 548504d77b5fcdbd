"""The graph in factors against the graph of edges, on graphs with hot names, aliases, repeated tags and walks that meet their roots."""

from __future__ import annotations

import random
import re

import pytest

from graphloom.bindings import graph as BG
from graphloom.operators import factored as X
from graphloom.operators import graph as G

TAGS = "rel_fname string, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, tag_seq int"


def table(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def made(spark):
    rng, tags = random.Random(11), []
    names = ["hot", "hot", "warm", "n0", "n1", "n2", "n3"]
    for i in range(48):
        f, name = f"f{i % 3}", rng.choice(names) if i > 5 else names[i]
        tags.append((f, name, "def", i, i, 100 * i, 100 * i + 99, i))
        if i % 11 == 0:
            tags.append((f, name, "def", i, i, 100 * i, 100 * i + 99, i + 500))
        tags += [(f, rng.choice(["hot", "warm", "WARM", "also", "once", "n0", "n1", "gone"]), "ref", i, i, 100 * i + 5 + k, 100 * i + 6 + k, 1000 + 10 * i + k) for k in range(rng.randint(0, 4))]
    tags.append(("f0", "once", "def", 90, 90, 9000, 9099, 90))
    tags.append(("f1", "hot", "ref", 1, 1, 110, 111, 2000))
    t = spark.createDataFrame(tags, TAGS)
    a = spark.createDataFrame([("f0", "WARM", "warm"), ("f1", "also", "hot"), ("f2", "also", "n0"), ("f2", "n1", "once")], "rel_fname string, name string, target_name string")
    e = G.cut(G.call_graph(t, a), "edges")
    refs, found = G.enclosed_refs(t), G.candidates(t, a)
    imp = G.cut(G.fan_in(G.nodes(t), e), "importance")
    used, reached = G.cut(X.uses(refs, found), "uses"), X.callees(found)
    return t, a, e, imp, used, reached, X.Walks(used, imp)


def test_edges_counts_and_confident_edges(made):
    _, _, e, _, used, reached, walks = made
    assert table(X.edges(used, reached)) == table(e)
    assert table(X.confident_edges(used, reached)) == table(e.filter("confident").select(*G.CALLER, *G.CALLEE))
    want = e.groupBy(*G.CALLER, "confident").agg({"*": "count", "weight": "sum"}).toDF(*G.CALLER, "confident", "a", "b")
    got = {(r.caller_file, r.caller_name, r.caller_line, r.confident): (r.edges, r.weight) for r in X.edge_sums(used, reached).groupBy(*G.CALLER, "confident").sum("edges", "weight").toDF(*G.CALLER, "confident", "edges", "weight").collect()}
    assert sorted(map(sorted, got.values())) == sorted(sorted((r.a, r.b)) for r in want.collect())
    assert table(walks.callers_counted()) == table(e.filter("confident").groupBy(*G.CALLEE).count().toDF(*G.NODE, "callers"))


@pytest.mark.parametrize("cap", [1, 2, 15])
def test_context_and_trace(spark, made, cap):
    t, _, e, imp, _, _, walks = made
    assert table(X.function_context(walks, cap)) == table(G.function_context(e, imp, cap))
    roots = G.nodes(t).withColumn("root", G.F.col("line"))
    for got, want in zip(X.call_trace(walks, roots, 4, cap), G.call_trace(e, imp, roots, 4, cap), strict=True):
        assert table(got) == table(want)


@pytest.mark.parametrize(("cap", "block"), [(1, 1 << 18), (2, 7), (15, 5)])
def test_walks_of_groups_equal_walks_of_roots(spark, made, cap, block, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", block)
    t, _, e, imp, _, _, walks = made
    roots = G.nodes(t).withColumn("root", G.F.col("line"))
    for got, want in zip(X.blast_radius(walks, roots, 4, cap), G.blast_radius(e, imp, roots, 4, cap), strict=True):
        assert table(got) == table(want) and want.columns


def test_update_of_factors(spark, made):
    new, a, e, *_ = made
    for file in ("f1", ["f0", "f2"]):
        old = new.filter("rel_fname <> 'f1' OR tag_seq % 3 > 0").withColumn("name", G.F.expr("CASE WHEN kind = 'def' AND rel_fname = 'f0' AND start_line % 2 = 0 THEN 'old' ELSE name END")) if file != "f1" else new.filter("rel_fname <> 'f1' OR tag_seq % 3 > 0")
        now = new if file == "f1" else new.filter("rel_fname <> 'f1' OR tag_seq % 3 > 0")
        refs, found = X.update_factors(G.enclosed_refs(old), G.candidates(old, a), old, now, a, file)
        assert table(X.edges(X.uses(refs, found), X.callees(found))) == table(G.call_graph(now, a))


def test_reindex_of_factors(spark, made):
    """After files were read anew, with the same aliases and with others; the number of their definitions comes along."""
    new, a, *_ = made
    old = new.filter("rel_fname <> 'f1' OR tag_seq % 3 > 0")
    for was in (a, a.limit(0), a.filter("name <> 'also'")):
        refs, found, n = X.reindex_factors(G.enclosed_refs(old, whole=False), G.candidates(old, was), old, new, was, a, ["f1"])
        assert table(X.edges(X.uses(refs, found), X.callees(found))) == table(G.call_graph(new, a))
        assert n == new.filter("rel_fname = 'f1' AND kind = 'def'").count()


def test_reindex_makes_no_contributions(spark, monkeypatch):
    """The counts after a reindex come of the factors; a row a caller, name and candidate is made nowhere."""
    monkeypatch.setattr(G, "contributions", None)
    got = BG.QUERIES["g10_reindex_file"](spark, "/root/testdata/sf0.001")
    assert got.count() == 1


def test_queries_write_no_edges(spark, monkeypatch):
    """References times candidates of a name are paired nowhere but in what is returned."""
    labels, cut = [], G.cut
    seen = lambda df, label, *rest: (labels.append(label), cut(df, label, *rest))[1]
    monkeypatch.setattr(G, "cut", seen)
    for name in ("a2_edge_fold", "a5_omitted_counts", "a15_dangling_nodes", "g4_pagerank_12iter", "t1_ranked_functions", "g5_function_context"):
        BG.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert labels and not {"edges", "old-parts", "old-edges"} & set(labels)


def test_rank_by_names_steps_over_kinds_of_nodes(spark, made, monkeypatch):
    t, a, e, *_ = made
    steps, cut = [], G.cut

    def seen(df, label, *rest):
        out = cut(df, label, *rest)
        if label in ("rank-x", "rank-candidates"):
            steps.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", seen)
    got = {r[:3]: r[3] for r in map(tuple, G.pagerank_by_names(G.nodes(t), G.enclosed_refs(t), G.candidates(t, a), iterations=6, tolerance=None).collect())}
    assert max(steps) < G.nodes(t).count()
    monkeypatch.setattr(G, "cut", cut)
    want = {r[:3]: r[3] for r in map(tuple, G.pagerank(G.nodes(t), e, iterations=6, tolerance=None).collect())}
    assert got.keys() == want.keys() and max(abs(v - got[k]) for k, v in want.items()) < 1e-12


def test_placing_references_shuffles_them_twice(spark):
    """Once to their bucket and once to be counted; definitions that share a span or nest go by width, then tag."""
    rows = [("f", "a", "def", 1, 9, 0, 9000, 1), ("f", "b", "def", 2, 3, 4000, 4200, 2), ("f", "c", "def", 2, 3, 4000, 4200, 3), ("f", "x", "ref", 2, 2, 4090, 4100, 4), ("f", "x", "ref", 2, 2, 4090, 4100, 5), ("f", "x", "ref", 2, 2, 4190, 4201, 6), ("f", "x", "ref", 9, 9, 8990, 9001, 7), ("g", "x", "ref", 1, 1, 5, 6, 8)]
    out = G.enclosed_refs(spark.createDataFrame(rows, TAGS))
    assert {tuple(r) for r in out.select("caller_name", "caller_line", "refs").collect()} == {("a", 1, 1), ("b", 2, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan  # no row of a reference and one span of several is grouped by the reference


def test_levels_of_a_walk_are_shuffled_once(spark, made, monkeypatch):
    """What a level meets is not joined with what was seen before, but grouped with it."""
    plans, cut = [], X.cut
    seen = lambda df, label, *rest: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if label == "walk-new" else None, cut(df, label, *rest))[1]
    monkeypatch.setattr(X, "cut", seen)
    t, *_, walks = made
    X.blast_radius(walks, G.nodes(t).withColumn("root", G.F.col("line")), 3, 2)
    assert len(plans) == 2 and not any(re.search(r"LeftOuter, .*\bb#", p) for p in plans)


def test_index_shuffles_references_once_to_place_and_once_to_link_them(spark, made, monkeypatch):
    """References counted where they lie add up to the same, and names and groups, which are few, do not deal them out again."""
    t, a, _, imp, used, _, walks = made
    refs, found = G.enclosed_refs(t, whole=False), G.candidates(t, a)
    whole = G.enclosed_refs(G.slim(t))
    assert table(refs.groupBy(*G.CALLER, "name").agg(G.F.sum("refs").alias("refs"))) == table(whole)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(whole).count("Exchange hashpartitioning") == plan(refs).count("Exchange hashpartitioning") + 1
    plans, cut = {}, X.cut
    monkeypatch.setattr(X, "cut", lambda df, label, *rest: (plans.update({label: plan(df)}), cut(df, label, *rest))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = X.Walks(X.uses(G.cut(refs, "refs"), G.cut(found, "candidates")), imp)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert table(both.links) == table(walks.links) and table(X.uses(refs, found)) == table(used)
    by = re.findall(r"Exchange hashpartitioning\((\w+)#", plans["walk-links"])
    assert by.count("caller_file") == 2  # references, and the nodes that they meet
    assert plans["walk-links"].count("REPARTITION_BY_COL") == 1 and not re.search(r"SortMergeJoin \[(callee_)?name#", plans["walk-links"])


def test_last_level_of_a_walk_keeps_no_whole_sets(spark, made, monkeypatch):
    """Its first nodes, count and own nodes are all that is written of it, and they come of the one grouping."""
    frames, cut = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df, label, *rest: (frames.append((label, df)), cut(df, label, *rest))[1])
    t, *_, walks = made
    X.blast_radius(walks, G.nodes(t).withColumn("root", G.F.col("line")), 3, 2)
    assert ["new" in df.columns for label, df in frames if label == "walk-new"] == [True, False]
    hits = [df._jdf.queryExecution().optimizedPlan().toString() for label, df in frames if label == "walk-hits"]
    assert not any("Join" in p for p in hits[1:])


def test_edges_are_dealt_out_by_their_number(spark, made, monkeypatch):
    """Two small tables that make many edges make them in many tasks, those of a hot name too."""
    _, _, e, _, used, reached, _ = made
    monkeypatch.setattr(X, "PAIRS", 8)
    out = X.edges(used, G.cut(reached, "callees"))
    assert table(out) == table(e)
    sizes = [r["count"] for r in out.groupBy(G.F.spark_partition_id()).count().collect()]
    hot = out.filter("callee_name = 'hot'").groupBy(G.F.spark_partition_id()).count().count()
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3 and hot > 1
    assert X.edges(used, G.cut(reached.limit(0), "callees")).count() == 0
