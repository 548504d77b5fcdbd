"""Rows that near-duplicate removal must tell apart: repeated rows, null ids, and an id at several texts."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

FORM = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], FORM)
    return Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def words(letter, n=60):
    return " ".join(f"{letter}{i}" for i in range(n))


def test_one_row_of_each_class_and_no_other_is_dropped(spark):
    near = words("c", 120).replace("c60", "other")
    rows = [
        (1, words("a")), (1, words("a")),  # one row, twice
        (None, words("b")), (None, words("d")),  # null ids, two classes
        (2, words("e")), (2, words("f")),  # one id at two texts
        (3, words("c", 120)), (3, near), (None, near), (4, near),  # one class, its least id at two texts
        (None, words("g")), (None, words("g")),  # a class without an id
    ]
    got = kept(spark, rows)
    assert set(got.values()) == {1}
    assert {k for k in got if k[0] != 3} == {(1, words("a")), (None, words("b")), (None, words("d")), (2, words("e")), (2, words("f")), (None, words("g"))}
    assert len([k for k in got if k[0] == 3]) == 1


def test_short_texts_are_not_dropped_by_score(spark):
    prose = "the rows of the table were read by the tool and then written to the other side of the river " * 3
    junk = " ".join(f"zq{chr(97 + i % 26)}xj{chr(97 + i * 7 % 26)}w" for i in range(60))
    rows = [(i, prose, "en") for i in range(20)] + [(100, "A.", "en"), (101, "Zqx jwk vv.", "fr"), (102, junk, None), (103, "12 34", "en"), (104, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows], FORM)
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {100: "en", 101: "fr"} and len(got) == 22
