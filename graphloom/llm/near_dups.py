"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets, banding and exact verification.

A document is the multiset of its five-word shingles. For each shingle, Poisson processes over its weight range give
points in time with one of M labels; a signature holds the first time of each label. The weight axis is cut into the
dyadic ranges (0,1], (1,2], (2,4], ...: a shingle of weight w owns the ranges below w whole, and of the range around
w the points whose place, refined by halving, lies at or below w. Two signatures agree in a label with the
probability of the weighted Jaccard similarity. Documents that agree in all labels of a band are candidates, and
candidates are linked if the similarity of their multisets, computed from the whole texts, is THRESHOLD or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, identity, materialize, packed, small, small_batches
from graphloom.llm.components import components
from graphloom.llm.textops import gram_owner, grams, mix, pair, utf8, word_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: A band misses a pair of similarity 0.8 with probability 1 - 0.8**6; all 42 do so with 3e-6.
BANDS, ROWS = 42, 6
LABELS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not compared by text: four standard deviations below 0.8.
ESTIMATE = 0.70
#: Where a bucket holds several classes, so many texts outside of its largest one meet so many others in one task, and so many bytes of each.
HEADS, OTHERS, HEAD_BYTES, OTHER_BYTES = 1024, 8192, 8 << 20, 16 << 20
#: Pairs whose signatures are compared at once.
PAIRS = 1 << 16
#: Points generated at once.
POINTS = 1 << 19
#: A hub's text is sent once for every so many documents that are compared with it.
SALT_ROWS = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of each text, by text and hash. Texts of one to four words are one shingle."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    at, owner = gram_owner(first, SHINGLE)
    h = grams(words, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    size = np.diff(first)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(few):
        short = words[first[few]]
        for k in range(1, SHINGLE - 1):
            more = size[few] > k
            short[more] = pair(short[more], words[first[few[more]] + k], 90 + k)
        h, owner = np.concatenate([h, short]), np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """BagMinHash signatures (texts x LABELS first times; infinite where a text has no shingle)."""
    out = np.full((texts, LABELS), np.inf)
    total = np.bincount(owner, weights=weight, minlength=texts)
    todo, slack = np.flatnonzero(total > 0), 3.0
    while len(todo):
        limit = np.zeros(texts)
        limit[todo] = LABELS * (math.log(LABELS) + slack) / total[todo]  # by then all labels have mostly occurred
        mine = limit[owner] > 0
        _points(out, owner[mine], h[mine], weight[mine], limit)
        out[todo] = np.where(out[todo] <= limit[todo, None], out[todo], np.inf)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack = 2 * slack + math.log(LABELS)
    return out


def _points(out: np.ndarray, owner: np.ndarray, h: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> None:
    """Enter all points up to each text's limit into out."""
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # 1 for weight 1, 2 for 2, 3 for 3 and 4, ...
    item = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    below = np.where(level > 0, 2.0 ** (level - 1), 0.0)  # the range (below, below + rate]
    rate = np.maximum(below, 1.0)
    seed = mix(h[item] + level.astype(np.uint64) * _GOLD)
    share = np.minimum((weight[item] - below) / rate, 1.0)  # of the range that the weight owns
    owner, time, made, step, flat = owner[item], np.zeros(len(item)), 0, 1, out.reshape(-1)
    while len(seed):
        ended = []
        for a in range(0, len(seed), max(1, POINTS // step)):
            part = slice(a, a + max(1, POINTS // step))
            u = mix(seed[part, None] + (np.arange(made, made + step, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[part, None]
            gap[:, 0] += time[part]
            t = np.cumsum(gap, axis=1)
            v = mix(u ^ _GOLD)
            label = ((v >> np.uint64(32)) * np.uint64(LABELS)) >> np.uint64(32)
            place = (v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32  # its bits are the halvings of the range
            good = (t <= limit[owner[part], None]) & (place < share[part, None])
            where = owner[part, None] * LABELS + label.astype(np.int64)
            np.minimum.at(flat, where[good], t[good])
            ended.append(t[:, -1])
        time = np.concatenate(ended)
        on = time <= limit[owner]
        seed, rate, share, owner, time = seed[on], rate[on], share[on], owner[on], time[on]
        made += step
        step = min(64, 2 * step)


_SIGNED = "doc_id long, h1 long, h2 long, size long, buckets array<long>, bytes binary"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("buckets", pa.list_(pa.int64())), ("bytes", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            owner, h, weight = shingles(batch.column("text"))
            sig = signatures(owner, h, weight, batch.num_rows)
            some = ~np.isinf(sig[:, 0])
            bits = mix(sig.view(np.uint64))
            bucket = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (batch.num_rows, BANDS))
            for k in range(ROWS):
                bucket = mix(bucket * np.uint64(0xA0761D6478BD642F) + bits[:, k::ROWS])
            flat = pa.array(np.ascontiguousarray(bucket[some]).view(np.int64).ravel())
            offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            low = np.ascontiguousarray((bits & np.uint64(0xFF)).astype(np.uint8))
            data = pa.array([low[i].tobytes() if some[i] else None for i in range(batch.num_rows)], pa.binary())
            own = [batch.column(c).cast(pa.int64()) for c in ("doc_id", "h1", "h2", "size")]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(offsets), flat), data], schema=_SIGNED_ARROW)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with signature bytes, those whose estimated similarity is ESTIMATE or more."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LABELS) for c in ("a_bytes", "b_bytes"))
        share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256) if batch.num_rows else np.zeros(0)
        yield batch.select(["a", "b"]).filter(pa.array(share >= ESTIMATE))



def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups (bucket, block, slice), of least rows or more but for the last, of rows sorted by group and `other`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        key = np.stack([np.asarray(table.column(c)) for c in ("bucket", "block", "slice")])
        edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if len(edge):
            yield table.slice(0, int(edge[-1]) + 1)
            held = table.slice(int(edge[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Meeting:
    """The pairs of whole groups: each head with the others of its group and, in slice 0, with the later heads."""

    def __init__(self, table: pa.Table) -> None:
        key = np.stack([np.asarray(table.column(c)) for c in ("bucket", "block", "slice")])
        other, n = np.asarray(table.column("other")), table.num_rows
        new = np.ones(n, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        end = np.append(start[1:], n)
        heads = np.add.reduceat(~other, start, dtype=np.int64) if n else start
        self.head = np.flatnonzero(~other)
        own = group[self.head]
        self.first = np.where(key[2, self.head] == 0, self.head + 1, start[own] + heads[own])
        self.last = end[own]
        self.label, self.band = np.asarray(table.column("label")), np.asarray(table.column("band"))
        self.sig = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, LABELS)

    def alike(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y), by x, of different classes whose estimate is ESTIMATE or more, in the first bucket that they share."""
        count = self.last - self.first
        ends, at = np.cumsum(count), 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = count[at:to]
            x = np.repeat(self.head[at:to], n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at:to], n)
            apart = self.label[x] != self.label[y]
            x, y = x[apart], y[apart]
            same = self.sig[x] == self.sig[y]
            near = (same.mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= ESTIMATE if len(x) else np.zeros(0, bool)
            x, y, same = x[near], y[near], same[near]
            earlier = same.reshape(-1, BANDS, ROWS).all(axis=2) & (np.arange(BANDS) < self.band[x][:, None])
            fresh = ~earlier.any(axis=1)
            if fresh.any():
                yield x[fresh], y[fresh]
            at = to


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of whole groups, those that have a pair to be compared by text: a row at most for each that came."""
    for table in _groups(batches, 4096):
        found = [np.unique(np.concatenate(p)) for p in _Meeting(table).alike()]
        if found:
            hit = table.take(pa.array(np.unique(np.concatenate(found))))
            yield hit.select(_MET).combine_chunks().to_batches()[0]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of class labels that join the classes of each group: texts are compared unless a link has joined their classes already."""
    for table in _groups(batches, 256):
        met = _Meeting(table)
        owner, h, n = shingles(table.column("text"))
        _, code = np.unique(h, return_inverse=True)
        bounds = np.searchsorted(owner, np.arange(table.num_rows + 1))
        total = np.bincount(owner, weights=n, minlength=table.num_rows).astype(np.int64)
        held = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = parent.get(up, up)
                v = up
            return v

        links = []
        for xs, ys in met.alike():
            for x in np.unique(xs).tolist():
                mine = find(int(met.label[x]))
                y = ys[xs == x]
                y = y[[find(v) != mine for v in met.label[y].tolist()]]
                if not len(y):
                    continue
                own = slice(bounds[x], bounds[x + 1])
                held[code[own]] = n[own]
                size = bounds[y + 1] - bounds[y]
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[y], size)
                both = np.bincount(np.repeat(np.arange(len(y)), size), weights=np.minimum(held[code[at]], n[at]), minlength=len(y)).astype(np.int64)
                held[code[own]] = 0
                for label in met.label[y[5 * both >= 4 * (total[x] + total[y] - both)]].tolist():  # min / max >= THRESHOLD, in whole numbers
                    a, b = find(mine), find(label)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        links.append((a, b))
        if links:
            yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in links], pa.int64()), "b": pa.array([v[1] for v in links], pa.int64())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (a, salt, b, text) sorted by a, salt and b: a hub's own row (b null) comes before those compared with it."""
    hub = None
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            owner, h, n = shingles(batch.column("text"))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                own = slice(bounds[i], bounds[i + 1])
                if b is None:
                    hub = (a, h[own], n[own])
                    continue
                _, h2, n2 = hub
                at = np.minimum(np.searchsorted(h2, h[own]), len(h2) - 1)
                both = int(np.minimum(n2[at], n[own])[h2[at] == h[own]].sum())
                if 5 * both >= 4 * (int(n2.sum()) + int(n[own].sum()) - both):  # min / max >= THRESHOLD, in whole numbers
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


_MET = ["bucket", "band", "node", "label", "size", "bytes"]
_SURVIVOR = "bucket long, band int, node long, label long, size long, bytes binary"


def _dealt(rows: DataFrame, keep: list[str], by_bytes: bool) -> DataFrame:
    """rows(bucket, node, label, size, ...) of buckets that hold several classes, in groups (bucket, block, slice).

    The texts outside of a bucket's largest class are its heads, in blocks; each block meets all other texts of the
    bucket, in slices. A head comes once for each slice and an other once for each block, so that rows stay in
    proportion to the bucket while one block holds its heads, and a task never holds more than a block and a slice.
    """
    by_label = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    most = F.struct("n", "label")
    impure = by_label.groupBy("bucket").agg(F.max_by("label", most).alias("main"), F.max("n").alias("main_n"), F.max_by("bytes", most).alias("main_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks, slices = F.ceil((F.col("n") - F.col("main_n")) / HEADS), F.ceil(F.col("n") / OTHERS)
    if by_bytes:
        blocks = F.greatest(blocks, F.ceil((F.col("bytes") - F.col("main_bytes")) / HEAD_BYTES))
        slices = F.greatest(slices, F.ceil(F.col("bytes") / OTHER_BYTES))
    impure = impure.filter("n > main_n").select("bucket", "main", blocks.cast("int").alias("blocks"), slices.cast("int").alias("slices"))
    impure = materialize(impure, "near-impure")
    met = rows.join(small(impure), "bucket")
    head, own = F.col("label") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    place = lambda b, s, other: F.struct(b.cast("int").alias("block"), s.cast("int").alias("slice"), F.lit(other).alias("other"))
    own_slice = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("slices"))
    as_head = F.when(head, F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: place(own, s, False))).otherwise(F.array().cast("array<struct<block:int,slice:int,other:boolean>>"))
    upto = F.when(head, own).otherwise(F.col("blocks"))
    as_other = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks")), lambda b: b < upto), lambda b: place(b, own_slice, True))
    return met.select(*keep, F.explode(F.concat(as_head, as_other)).alias("at")).select(*keep, "at.*")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "block", "slice").sortWithinPartitions("bucket", "block", "slice", "other")


class _Search:
    """A node is a distinct text, known by a number of its own that stands for its 128 bits."""

    def __init__(self, documents: DataFrame) -> None:
        small_batches(documents.sparkSession)
        h1, h2 = identity(F.col("text"))
        self.texts = documents.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
        self.rows = materialize(self.texts.mapInArrow(_sign, _SIGNED), "near-rows")
        some = self.rows.filter("bytes IS NOT NULL").groupBy("h1", "h2")
        signed = some.agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("bytes").alias("bytes"))
        self.signed = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "near-signed")  # written once, so the numbers stay
        buckets = self.signed.select("node", F.posexplode("buckets").alias("band", "bucket"))
        hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
        self.hubs = materialize(hubs, "near-hubs")
        self.members = materialize(buckets.join(small(self.hubs), "bucket"), "near-members")  # the buckets that hold two texts or more

    def text_of(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of wanted(node): the text of one row each, of the least id."""
        keys = wanted.join(self.signed.select("node", "h1", "h2", "rep"), "node").select("node", F.col("h1").alias("w1"), F.col("h2").alias("w2"), "rep")
        keys = materialize(keys, "near-wanted")
        same = (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
        texts = self.texts.join(small(keys), same).select("node", "text")
        out = materialize(texts.dropDuplicates(["node"]) if self.repeated() else texts, "near-texts", "zstd")
        discard(keys)
        return out

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links of pairs(a, b): estimated by signature, then compared by whole text."""
        sig = self.signed.select("node", "bytes")
        a, b = sig.select(F.col("node").alias("a"), F.col("bytes").alias("a_bytes")), sig.select(F.col("node").alias("b"), F.col("bytes").alias("b_bytes"))
        near = materialize(pairs.select("a", "b").join(b, "b").join(a, "a").mapInArrow(_alike, "a long, b long"), "near-pairs")
        texts = self.text_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        salts = near.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
        salts = materialize(salts, "near-salts")
        salted = near.join(small(salts), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
        compared = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
        heads = salts.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        met = heads.unionByName(compared).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        links = materialize(met.mapInArrow(_verify, "a long, b long"), "near-links")
        discard(near, texts, salts)
        return links

    def search(self, label: DataFrame) -> DataFrame:
        """Links (a, b) of labels, for all pairs of different labels(node, label) that share a bucket."""
        mixed = self.members.select("bucket", "band", "node").join(small(label), "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
        mixed = materialize(mixed.withColumn("size", F.lit(0).cast("long")), "near-mixed")
        dealt = _dealt(mixed, ["bucket", "band", "node", "label"], False).join(self.signed.select("node", "size", "bytes"), "node")
        near = _together(dealt.select(*_MET, "block", "slice", "other")).mapInArrow(_survivors, _SURVIVOR)
        near = materialize(near.dropDuplicates(["bucket", "node"]), "near-survivors")
        texts = self.text_of(near.select("node").distinct())
        dealt = _dealt(near, _MET, True).join(texts, "node")
        links = materialize(_together(dealt.select(*_MET, "block", "slice", "other", "text")).mapInArrow(_spanning, "a long, b long"), "near-spanning")
        discard(mixed, near, texts)
        return links

    def repeated(self) -> bool:
        """Whether rows repeat in both id and text."""
        if not hasattr(self, "_repeated"):
            again = self.rows.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
            self._repeated = bool(again.head(1))
        return self._repeated


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, label, class_id) of each row of documents(doc_id, text); class_id is the least doc_id of the class.

    h1 and h2 are the text's identity. label tells classes of one class_id apart (an id may stand at several texts);
    it is null where a text has no words.

    A class is a connected component of the links of similarity THRESHOLD or more. Exact copies are one text, and all
    the following is about different texts. Every text is compared first with the text that is the least in most of
    its buckets, which joins most classes. Then every bucket that still holds several classes is searched: the texts
    outside of its largest class meet all its texts, by signature and then by whole text, within a task, which sends
    on no more than the links that join classes. So every candidate pair is compared unless its two texts are in one
    class already, and no bucket is expanded into all pairs. Defined cases: a text without words (null, empty, blank)
    is its own class; fewer than five words are one shingle; texts of any length are read whole; a null doc_id is
    never a class's id unless no other is there; ties fall to the smaller id; repeated rows are of one class; extra
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    s = _Search(documents)
    by_hub = s.members.filter("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("n"))
    order = F.struct("n", (-F.col("hub")).alias("order"))
    first = materialize(by_hub.groupBy(F.col("node").alias("b")).agg(F.max_by("hub", order).alias("a")).select("a", "b"), "near-first")
    links = s.verify(first)
    label = components(links)
    joined = s.search(label)
    if joined.head(1):
        over = components(joined).select(F.col("node").alias("label"), F.col("label").alias("over"))
        old, roots = label, over.select(F.col("label").alias("node"), F.col("over").alias("label"))
        label = old.join(small(over), "label", "left").select("node", F.coalesce("over", "label").alias("label"))
        label = materialize(label.unionByName(roots.join(old.select("node"), "node", "left_anti")), "near-label")
    discard(first, links, joined)

    named = s.signed.select("node", "h1", "h2", "rep").join(small(label), "node", "left").select("h1", "h2", "rep", F.coalesce("label", "node").alias("label"))
    low = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")).filter("n > 1").select("label", "class_id")
    low = materialize(low, "near-roots")
    known = named.join(small(low), "label", "left").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "label", F.coalesce("class_id", "rep").alias("class_id"))
    known = materialize(known, "near-classes")
    discard(s.signed, s.hubs, s.members, low)
    out = s.rows.select("doc_id", "h1", "h2", F.col("bytes").isNotNull().alias("some"))
    out = out.join(known, F.col("some") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    out = out.select("doc_id", "h1", "h2", "label", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    out._reads = (s.rows, known)  # tables of ours that go when nothing reads the result any more
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (whether the document is the one that stays) of each row; see classes."""
    return classes(documents).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class of documents(doc_id, text, ...): of the least doc_id, null only where there is no other, then of the least text identity.

    Defined cases: texts without words (null, empty, blank) all stay, repeated or not; a row repeated in id and text
    stays once, by the least hash of its columns; an id at texts of several classes keeps a row in each; columns pass
    through, whatever their names; an empty table stays empty. See classes for the others.
    """
    every = classes(documents)
    found = materialize(every.filter("label IS NOT NULL").select("doc_id", "h1", "h2", "label"), "once-classes")
    discard(*every._reads)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h1").alias("h1"), F.col("h2").alias("h2"))
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1").select("label", "best")
    best = materialize(best, "once-best")  # of the classes of several rows
    met = found.join(small(best), "label").select("doc_id", "h1", "h2", (order != F.col("best")).alias("late"))
    met = met.groupBy("doc_id", "h1", "h2").agg(F.first("late").alias("late"), F.count("*").alias("n")).filter("late OR n > 1")
    met = materialize(met.select(F.col("doc_id").alias("m_id"), F.col("h1").alias("m1"), F.col("h2").alias("m2"), "late"), "once-met")
    h1, h2 = identity(F.col("gl_row.text"))
    rows = packed(documents)
    same = F.col("gl_row.doc_id").eqNullSafe(F.col("m_id")) & (h1 == F.col("m1")) & (h2 == F.col("m2"))
    out = rows.join(small(met.filter("late")), same, "left_anti")
    again = met.filter("NOT late")  # the row that stays stands there more than once
    if again.head(1):
        columns = [F.col("gl_row")[c] for c, t in documents.dtypes if "map<" not in t]
        key = [h1.alias("h1"), h2.alias("h2"), F.col("gl_row.doc_id").alias("id")]
        once = out.join(small(again), same, "left_semi").groupBy(*key).agg(F.min_by("gl_row", F.xxhash64(*columns)).alias("gl_row")).select("gl_row")
        out = out.join(small(again), same, "left_anti").unionByName(once)
    discard(found, best)
    return out.select("gl_row.*")
