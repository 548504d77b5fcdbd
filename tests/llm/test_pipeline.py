"""Each stage of the pipeline against its brute-force version, on the edge table with all its extra columns."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import near_dups, packing, tokens
from graphloom.llm.common import materialize
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def clashing(edge):
    """The edge table with names that the stages use inside."""
    names = ["l_node", "l_doc_id", "gl_doc_id", "label", "h1", "h2", "best", "late", "m_id", "lang_pred", "grams", "class_id", "row", "copy", "shard", "place", "id", "run", "cell", "number", "start", "taken", "k`x", "a.b"]
    return edge.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names}).withColumn("text", F.col("text")).cache()


def test_order_of_stages():
    assert list(STAGES) == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]


def own(df):
    return Counter((r.doc_id, r.text, r.lang) for r in df.collect())


def test_language_stage(spark, clashing):
    out = materialize(STAGES["language_id"](spark, clashing, ""), "t1")
    assert out.columns == clashing.columns
    rows = [(r.doc_id, r.text, r.lang) for r in clashing.collect()]
    want = Counter()
    for (d, t, lang), (found, score, n) in zip(rows, brute.languages(rows), strict=True):
        assert abs(score - corpus_pipeline.LEAST_SCORE) > 0.02 or n < corpus_pipeline.LEAST_GRAMS or found == "und"  # no row of the table hangs on the filters' own error
        if found != "und" and (score >= corpus_pipeline.LEAST_SCORE or n < corpus_pipeline.LEAST_GRAMS):
            want[(d, t, found if score >= corpus_pipeline.LEAST_SCORE else lang)] += 1
    assert own(out) == want
    assert all(r["score"] == "s" and r["lang_pred"] in (f"lang_pred-{r.doc_id}", None) for r in out.collect())


def test_near_duplicate_stage(spark, clashing):
    out = materialize(STAGES["near_duplicates"](spark, clashing, ""), "t2")
    assert out.columns == clashing.columns
    h1, h2 = near_dups.identity(F.col("text"))
    rows = [(r.doc_id, r.text, r.a, r.b) for r in clashing.select("doc_id", "text", h1.alias("a"), h2.alias("b")).collect()]
    want, groups = Counter(), defaultdict(list)
    for r, c in zip(rows, brute.classes([r[1] for r in rows]), strict=True):
        if brute.words(r[1]):
            groups[c].append(r)
        else:
            want[(r[0], r[1])] += 1
    for group in groups.values():
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3]))
        want[(best[0], best[1])] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_substring_stage(spark, clashing):
    docs = clashing
    out = materialize(STAGES["substring_dedup"](spark, docs, ""), "t3")
    assert out.columns == docs.columns
    rows, want = [(r.doc_id, r.text) for r in docs.collect()], Counter()
    for (d, t), (w, kept) in zip(rows, brute.without_repeats(rows), strict=True):
        if len(kept) == len(w):
            want[(d, t, None if t is None else len(t))] += 1
        elif kept:
            want[(d, " ".join(kept), len(" ".join(kept)))] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want


def test_mixing_stage(spark, clashing):
    out = materialize(STAGES["mixing"](spark, clashing, ""), "t4")
    assert out.columns == clashing.columns
    rows = clashing.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(brute.words(r.text))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, brute.targets([size[s] for s in names]), strict=True))
    got, texts, used = defaultdict(int), defaultdict(list), Counter()
    for r in rows:
        texts[r.doc_id].append(brute.words(r.text))
    for r in out.collect():
        w = brute.words(r.text)
        assert w and any(w == x[i : i + len(w)] for x in texts[r.doc_id] for i in range(len(x) - len(w) + 1)) and r.n_chars == len(r.text)
        got[r.source] += len(w)
        used[r.doc_id] += len(w)
    assert all(abs(got[s] - want[s]) <= 1 for s in names)
    assert all(used[d] <= 2 * sum(map(len, x)) for d, x in texts.items())
    assert own(STAGES["mixing"](spark, clashing.repartition(2), "")) == own(out)


def test_packing_stage(spark, clashing):
    t = tokens.tokenizer(tokens.default_vocabulary())
    want, got, fill = Counter(), Counter(), Counter()
    for r in clashing.collect():
        want[(r.doc_id, len(t.ids(r.text)) // 4 + 1)] += len(t.ids(r.text)) // 4 + 1
    for p in STAGES["packing"](spark, clashing, "").collect():
        got[(p.doc_id, p.doc_tokens)] += p.length
        fill[p.sequence_id] += p.length
    assert got == want and max(fill.values()) <= packing.CAPACITY


def test_the_whole_run_equals_its_stages(spark, edge_rows, tmp_path):
    form = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(edge_rows, form).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), f"w-{name}")
    key = lambda df: Counter((r.doc_id, r.doc_tokens, r.ids_crc32, r.start, r.length) for r in df.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in docs.collect()) > 0
    assert {k[:2] for k in key(whole)} == {k[:2] for k in key(docs)}


def test_an_empty_table_goes_through(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"e-{name}")
        assert docs.count() == 0


