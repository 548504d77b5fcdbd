"""Queries answer for every row of their tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from graphloom import bindings
from graphloom.bindings import graph as BG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables are not here")


def run(spark, name):
    return bindings.QUERIES[name](spark, SF)


def test_every_function_has_its_blast_radius_and_trace(spark):
    sure = {(x.caller_line, x.callee_line) for x in BG.edges(spark, SF).filter("confident").collect()}
    called, calling = {c for a, c in sure if a != c}, {a for a, _ in sure}
    radius = run(spark, "g7_blast_radius").collect()
    assert {x.root for x in radius} == called
    for root in called:
        callers = {a for a, c in sure if c == root} - {root}
        found = {x.line for x in radius if x.root == root and x.depth == 1}
        assert found <= callers and len(found) == min(15, len(callers))
    assert {x.root for x in run(spark, "g8_call_trace").collect()} == calling
    near = {a for a, c in sure} | {c for a, c in sure}
    assert {x.line for x in run(spark, "r5_stale_propagation").collect()} <= {k for k in near if k % 5}


def test_every_row_is_a_probe(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    assert run(spark, "j6_nearest_def").count() == parts.count()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert run(spark, "f6_context_hash").count() == orders.select("o_custkey").distinct().count()
    wanted = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "props").distinct().count()
    assert run(spark, "p8_uncached_targets").count() + run(spark, "j8_cached_targets").count() == wanted
    assert run(spark, "a13_cluster_members").agg(F.sum("members")).first()[0] == wanted


def test_every_vector_has_its_neighbours(spark):
    from graphloom.operators import vectors as V

    v = spark.createDataFrame([(f"f{i % 3}", i, i + 3, [float(i // 4), float(i % 2)]) for i in range(60)], "rel_fname string, start_line long, end_line long, vector array<float>")
    q = v.selectExpr("start_line AS query", "rel_fname AS q_file", "start_line AS q_start", "end_line AS q_end", "vector AS q_vector")
    want = sorted(map(tuple, V.nearest(q, v).collect()))
    assert len({x[0] for x in want}) == 60
    rows = v.collect()
    for a in (0, 7, 59):
        far = sorted((sum((x - y) ** 2 for x, y in zip(rows[a].vector, r.vector, strict=True)), r.rel_fname, r.start_line, r.end_line) for r in rows)[:20]
        kept = [r for r in far if not (r[1] == rows[a].rel_fname and r[2] < rows[a].end_line and r[3] > rows[a].start_line)][:5]
        assert [(x[2], x[3]) for x in want if x[0] == a] == [(r[1], r[2]) for r in kept]
    assert sorted(map(tuple, V.nearest(q, v, block=16).collect())) == want  # many ties, several blocks
    embeddings = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert run(spark, "v2_knn_overlap_filtered").select("query").distinct().count() == embeddings


def test_few_pairs_of_vectors_are_measured():
    import time

    import numpy as np

    from graphloom.operators import vectors as V

    def every(x, y, fetch=20):
        d = np.zeros((len(x), len(y)))
        for k in range(x.shape[1]):
            d += (x[:, k, None] - y[None, :, k]) ** 2
        d = np.floor(d * 1e9 + 0.5) / 1e9
        best = np.argsort(d, axis=1, kind="stable")[:, :fetch]
        return np.repeat(np.arange(len(x)), best.shape[1]), best.ravel(), np.take_along_axis(d, best, 1).ravel()

    rng = np.random.default_rng(5)
    odd = rng.normal(size=(5000, 8))
    odd[5], odd[9, 2], odd[4100:4130] = np.nan, np.inf, -np.inf
    ties, far = rng.integers(0, 3, (5000, 4)).astype(float), rng.normal(size=(5000, 8)) + 1e6
    with np.errstate(all="ignore"):
        for x, y in ((odd[:200], odd), (odd[:200], odd[:7]), (ties[:200], ties), (far[:200], far), (ties[:9], np.zeros((5000, 4)))):
            assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(every(x, y), V.closest(x, y, 20), strict=True))
    x, y = rng.normal(size=(512, 64)), rng.normal(size=(16384, 64))
    at = time.process_time()
    V.closest(x, y, 20)
    took = time.process_time() - at
    at = time.process_time()
    every(x[:64], y)
    assert took < 8 * (time.process_time() - at) / 3


def test_ranked_functions_hits_and_files_are_all_listed(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    ranked = run(spark, "t1_ranked_functions")
    assert sorted(x.pos for x in ranked.collect()) == list(range(1, parts.count() + 1))
    assert run(spark, "k10_ranked_dump").select("line").distinct().count() == parts.count()
    assert run(spark, "t9_search_by_label").count() == parts.filter("contains(p_name, 'ring')").count()
    many = spark.range(2000).selectExpr("concat('f', id) AS name", "id")
    spread = BG.G.positions(many.repartition(7), F.desc("id")).collect()
    assert {x.id: x.pos for x in spread} == {i: 2000 - i for i in range(2000)}


def test_digests_keep_the_operators_own_budgets(spark, tmp_path):
    spark.range(700).selectExpr("id AS doc_id", "repeat('x', 7000) AS text", "'en' AS lang", "'s' AS source", "7000L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    at = lambda name: bindings.QUERIES[name](spark, str(tmp_path))
    assert at("s6_walk_files").count() == 700
    assert at("a7_digest_counts").collect() == [(700, 285, 415, True)]
