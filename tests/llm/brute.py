"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def grams(text):
    """Byte 4-grams of the text's letters, runs of others made one space."""
    raw = (" " + regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip(" ") + " ").encode()
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3)]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def languages(rows, most=4000):
    """(lang, score, number of n-grams) of each of rows(doc_id, text, lang), by exact sets of the most frequent n-grams."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and not held_out(doc_id):
            counts[lang].update(grams(text))
    known = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]} for lang, c in counts.items()}
    out = []
    for _, text, _ in rows:
        own = grams(text)
        if not known or not regex.search(r"\p{L}", text or ""):
            out.append(("und", 0.0, len(own)))
            continue
        share = {lang: sum(g in s for g in own) / max(1, len(own)) for lang, s in known.items()}
        best = min(share, key=lambda x: (-share[x], x))
        out.append((best, share[best], len(own)))
    return out


def multiset(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """The class of each text, by number of the first one: components of the links of similarity 0.8 or more."""
    sets = [multiset(t) for t in texts]
    size = [sum(s.values()) for s in sets]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)  # only texts that share a shingle can be similar
    for i, s in enumerate(sets):
        near = {j for g in s for j in holders[g]}
        for j in near:
            if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
                both = sum((sets[i] & sets[j]).values())
                if 5 * both >= 4 * (size[i] + size[j] - both):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        for g in s:
            holders[g].append(i)
    return [find(i) for i in range(len(texts))]


def without_repeats(rows):
    """(words, kept words) of each of rows(doc_id, text)."""
    starts = defaultdict(set)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                starts[tuple(w[i : i + 13])].add(d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if d is not None and min(starts[tuple(w[i : i + 13])]) < d:
                gone |= set(range(i, i + 13))
        out.append((w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """Targets by bisection of the level at which the weighted shares, each up to its bound, add up."""
    want = min(share * sum(sizes), most * sum(sizes))
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        got = sum(min(most * s, weights[i % len(weights)] * level) for i, s in enumerate(sizes))
        low, high = (level, high) if got < want else (low, level)
    return [min(most * s, weights[i % len(weights)] * high) for i, s in enumerate(sizes)]
