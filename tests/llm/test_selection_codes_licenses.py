"""Importance resampling, vector codes and license scan against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import importance, licenses, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


# 11
def features(text, n=(1, 1)):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(n[0], n[1] + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, n=(1, 1), buckets=10_000, per_cent=10, least=20):
    """(doc_id, n_words, n_features, weight, score, drawn) of rows(doc_id, text)."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in rows for f in features(x, n)), Counter(at(f) for x in target for f in features(x, n))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for d, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(f)) for f in features(x, n))
        out.append((d, len(words(x)), len(features(x, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[1]))
    drawn = Counter((*x, i + 1) for i, x in enumerate(fit[: per_cent * len(fit) // 100]))
    left = Counter(out) - Counter(x[:-1] for x in drawn.elements())
    return drawn + Counter((*x, None) for x in left.elements())


TARGET = ["Word1 word2 WORD3, word4", None, "", "élan ÉLAN château", "word7 word7"]


@pytest.mark.parametrize("n", [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, edge, edge_rows, none, n):
    target = spark.createDataFrame([(x, "clash") for x in TARGET], "text string, doc_id string")
    got = Counter(tuple(r) for r in importance.resample(edge, target, per_cent=40, n=n).collect())
    assert got == resampled([(r[0], r[1]) for r in edge_rows], TARGET, n, per_cent=40)
    if n == (1, 1):
        assert importance.resample(none, target).count() == 0
        flat = importance.resample(edge, target.filter("false")).collect()  # an empty target
        assert Counter(tuple(r) for r in flat) == resampled([(r[0], r[1]) for r in edge_rows], [])


def test_many_ties_are_drawn_by_id(spark):
    rows = [(i % 50, "w " * 25) for i in range(400)] + [(None, "w " * 25)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w",)], "text string")
    assert Counter(tuple(r) for r in importance.resample(docs, target).collect()) == resampled(rows, ["w"])
    assert importance.drawn_documents(docs, target).count() == 40


def test_folding_reads_the_contract_words():
    text = "AbC-9é_Ünï\x7fx　y\n" + "".join(map(chr, range(256)))
    folded = text.encode().translate(importance.FOLDED).decode()
    assert [w for w in folded.split(" ") if w] == words(text)


# 12
def codes(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, code, error, label_error, digest): copies} of rows(vec_id, embedding, label) with Python's numbers."""
    kept = [(i, label, [math.floor(4096 * Fraction(x)) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    size = len(kept[0][2]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for p, x in enumerate(cut(v)):
                held[p][near(p, x)[1]].append(x)
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := held[p].get(k)) else e for k, e in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i, label, [near(p, x) for p, x in enumerate(cut(v))]) for i, label, v in kept]
    total = Counter()
    for _, label, found in out:
        total[label] += sum(d for d, _ in found)
    most = 2**63 - 1
    return Counter((i, "".join(f"{k:02x}" for _, k in found), min(most, sum(d for d, _ in found)), min(most, total[label]), digest) for i, label, found in out)


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(1000 - i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)], i % 5 or None) for i in range(300)]
    rows += [(900, rows[3][1], 2), (900, rows[3][1], 2), (None, rows[9][1], 1), (5, None, 1), (6, [None] + [0.5] * 15, 1), (7, [float("nan")] * 16, 1), (8, [float("inf")] * 16, 3), (9, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("own")).withColumn("data", F.lit(1)).repartition(3)
    want = codes(rows)
    assert Counter(tuple(r) for r in vector_codes.compress(df).collect()) == want
    monkeypatch.setattr(vector_codes, "BLOCK_NUMBERS", 16 * 7)  # blocks of seven vectors
    assert Counter(tuple(r) for r in vector_codes.compress(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).collect()) == want
    assert vector_codes.compress(df.filter("false")).count() == 0
    few = df.filter("vec_id > 995")
    assert Counter(tuple(r) for r in vector_codes.compress(few).collect()) == codes([r for r in rows if (r[0] or 0) > 995])
    coded, books = vector_codes.encode(few)
    back = {r.vec_id: r.vector for r in vector_codes.decoded(coded, books).collect()}
    assert all(np.abs(np.array(back[r[0]]) - np.array(r[1])).max() <= 1 / 4096 for r in rows if r[0] in back)  # each is an entry of its own


def test_vectors_that_cannot_be_cut_take_no_part(spark):
    rows = [(i, [i / 7.0] * 8, "a") for i in range(20)]
    df = spark.createDataFrame([*rows, (30, [1.0] * 7, "a"), (31, [1.0] * 16, "a")], "vec_id long, embedding array<double>, label string")
    assert Counter(tuple(r) for r in vector_codes.compress(df).collect()) == codes(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** (i % 25), 8)], "a" if i < 30 else "b") for i in range(60)] + [(70, [1.7e308, -1.7e308] + [0.0] * 6, "b"), (71, [0.25] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    assert Counter(tuple(r) for r in vector_codes.compress(df).collect()) == codes(rows)


# 13
def scanned(rows):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of rows(doc_id, text) by all blocks and templates."""
    out = Counter()
    for d, text in rows:
        w = words(text)
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        found, best = set(), 0.0
        for label, template in licenses.TEMPLATES:
            own, step = set(words(template)), licenses.step_of(template)
            for k in range(max(0, -(-len(w) // step) - 2) + 1):
                shared = len(own & set(w[k * step : (k + 2) * step]))
                if 10 * shared >= 9 * len(own):
                    found.add(label)
                    best = max(best, shared / len(own))
        base = {label for _, label in places}
        at = [i for i, _ in places]
        out[(d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else best)] += 1
    return out


def license_rows():
    full = licenses.TEMPLATES[1][1]
    lines = [t for _, t in licenses.TEMPLATES]
    filler = [f"filler{i % 90}" for i in range(400)]
    rows = [(i, " ".join(filler[: 13 * i]) + "\n" + t + "\n" + " ".join(filler[: 7 * i])) for i, t in enumerate(lines)]
    gaps = full.split(" ")
    rows += [
        (20, " ".join(gaps[:13] + gaps[15:])), (21, " ".join(gaps[:-6])), (22, " ".join(reversed(gaps))), (23, "MIT License mit license. The MIT  License!"), (24, "license mit"), (25, "Licensed under CC BY 4.0."),
        (26, "Apache License" + " x" * 50 + " General-Public-License, Apache licence"), (27, "Licensed under CC-BY-NC-4.0"), (28, None), (29, ""), (30, " \n "), (30, " \n "), (None, lines[0]), (31, "Kelvin mit Klicense"), (32, " ".join(filler * 40) + " " + lines[4] + " " + " ".join(filler * 40)),
    ]
    return rows


def test_licenses(spark, edge, edge_rows, none):
    rows = license_rows()
    clash = {"row": F.lit("r"), "step": F.lit(3), "blocks": F.lit("b"), "label": F.lit(None).cast("string"), "code": F.lit(1), "words": F.lit("w")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    got, want = Counter(tuple(r) for r in licenses.scan(docs).collect()), scanned(rows)
    assert got == want
    assert {x[6] for x in got} >= {"mit", "apache", "gpl", "cc-by-nc", "bsd", "", "apache,gpl"}
    assert Counter(tuple(r) for r in licenses.scan(edge).collect()) == scanned([(r[0], r[1]) for r in edge_rows])
    assert licenses.scan(none).count() == 0
    spans = licenses.blocks_found(docs).filter("template = 1").collect()
    held = {d: words(t) for d, t in rows}
    assert spans and all(len(set(held[r.doc_id][r.first_word : r.last_word + 1]) & set(words(licenses.TEMPLATES[1][1]))) == round(r.containment * len(set(words(licenses.TEMPLATES[1][1])))) for r in spans)


def test_license_join_with_other_thresholds_loses_nothing(spark):
    rng = np.random.default_rng(1)
    names = [f"t{i}" for i in range(14)]
    templates = tuple((f"l{k}", " ".join(rng.choice(names, 4 + k, replace=False))) for k in range(6))
    rows = [(i, " ".join(rng.choice(names + ["x", "y"], rng.integers(1, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tenths in (5, 7, 10):
        want = set()
        for d, t in rows:
            w = words(t)
            for label, template in templates:
                own, step = set(words(template)), licenses.step_of(template)
                if any(10 * len(own & set(w[k * step : (k + 2) * step])) >= tenths * len(own) for k in range(max(0, -(-len(w) // step) - 2) + 1)):
                    want.add((d, label))
        got = licenses.scan(docs, templates, (), tenths).collect()
        assert {(r.doc_id, x) for r in got for x in r.labels.split(",") if x} == want
    assert {(r.labels, r.score) for r in licenses.scan(docs, (), ()).collect()} == {("", 0.0)}
