"""Removal of word windows that repeat across documents, with a count-min prefilter.

First pass: every partition sketches its windows; the sketches, merged, never underestimate how many documents hold a
window. A window is counted through its minimizer, the least-hashed of its six sub-windows of eight words: equal
windows have equal minimizers, so a minimizer's count bounds the window's from above, at a quarter of the items.
Second pass: only windows whose estimate is two or more are grouped exactly, by 128-bit hashes. None is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import packed, small_batches
from graphloom.llm.textops import gram_owner, grams, mix, utf8, word_hashes, word_spans

WINDOW, CORE = 13, 8
#: Rows of the count-min sketch; cells of a row are a power of two, about four for each minimizer, up to MAX_LOG2_CELLS.
#: That bounds what is broadcast: a bit a cell, so 2 * 2**28 / 8 = 64 MB. Beyond it more windows go to the exact pass, and the result is the same.
SKETCH_ROWS, MIN_LOG2_CELLS, MAX_LOG2_CELLS = 2, 16, 28
#: Cells in a slice, the unit in which partial sketches are merged.
SLICE_BITS = 20
#: Words that are sketched or compared at once within a task.
CHUNK_WORDS = 1 << 17
#: Windows that a task remembers from its earlier chunks, so that one that stands in all documents goes out once a task, not once a chunk (24 bytes each).
REMEMBERED = 1 << 18


class _Texts:
    """The windows of some documents: minimizers, places and owners, and on demand the hashes of some of them."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        raw, offsets = utf8(table.column("text"))
        starts, ends, self.first = word_spans(raw, offsets)
        self.words = word_hashes(raw, starts, ends)
        del raw, starts, ends
        self.at, self.owner = gram_owner(self.first, WINDOW)
        if len(self.at):
            least = grams(self.words, CORE, seed=7)
            for step in (1, 2, 2):
                least = np.minimum(least[:-step], least[step:])
            self.minimizer = least[self.at]
        else:
            self.minimizer = np.zeros(0, np.uint64)
        ids = table.column("doc_id").combine_chunks()
        self.known = np.asarray(ids.is_valid())[self.owner]
        self.doc_id = np.asarray(ids.fill_null(0).cast(pa.int64()))

    def hashes(self, keep: np.ndarray, seed: int) -> np.ndarray:
        return grams(self.words, WINDOW, seed)[self.at[keep]]

    def release(self) -> None:
        """Drop what belongs to windows and words; documents stay."""
        del self.words, self.at, self.owner, self.minimizer, self.known

    def position(self, keep: np.ndarray) -> np.ndarray:
        return self.at[keep] - self.first[self.owner[keep]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= 6 * CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cells(minimizer: np.ndarray, row: int, log2: int) -> np.ndarray:
    return mix(minimizer + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - log2)


def _sketch(log2: int):  # noqa: ANN202
    """Partial sketches: for each slice, the sorted cells that a chunk's documents hit, and whether twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            t = _Texts(chunk)
            new = np.ones(len(t.minimizer), bool)
            new[1:] = (t.minimizer[1:] != t.minimizer[:-1]) | (t.owner[1:] != t.owner[:-1])
            new &= t.known
            m, doc = t.minimizer[new], t.doc_id[t.owner[new]]
            order = np.lexsort((doc, m))
            m, doc = m[order], doc[order]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])  # a document counts once
            m = m[new]
            out: dict[str, list] = {"slice": [], "hits": []}
            for row in range(SKETCH_ROWS):
                cell = np.sort(_cells(m, row, log2))
                fresh = np.ones(len(cell), bool)
                fresh[1:] = cell[1:] != cell[:-1]
                at = np.flatnonzero(fresh)
                twice = np.diff(np.append(at, len(cell))) > 1
                cell = cell[at]
                piece = (cell >> np.uint64(SLICE_BITS)).astype(np.int64)
                code = ((cell & np.uint64((1 << SLICE_BITS) - 1)) << np.uint64(1) | twice.astype(np.uint64)).astype(np.uint32)
                bounds = np.flatnonzero(np.diff(piece, prepend=-1, append=-2))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    delta = np.diff(code[a:b], prepend=np.uint32(0))
                    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 4).T).tobytes()
                    out["slice"].append((row << 32) | int(piece[a]))
                    out["hits"].append(len(planes).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True))
            if out["slice"]:
                yield pa.RecordBatch.from_pydict({"slice": pa.array(out["slice"], pa.int64()), "hits": pa.array(out["hits"], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged slices, of partial ones in the order of their slice: a bit for each cell that two or more documents hit."""
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        bits = np.packbits(twice, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int64()), "bits": pa.array([bits], pa.binary())})

    for batch in batches:
        for piece, hits in zip(batch.column("slice").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if piece != now:
                if now is not None:
                    yield done()
                now, once, twice = piece, np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
            planes = np.frombuffer(pa.decompress(hits[4:], int.from_bytes(hits[:4], "little"), "zstd", asbytes=True), np.uint8)
            code = np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)
            cell = code >> np.uint32(1)
            twice[cell] |= once[cell] | ((code & np.uint32(1)) > 0)
            once[cell] = True
    if now is not None:
        yield done()


def _repeated(bits: np.ndarray, minimizer: np.ndarray, log2: int) -> np.ndarray:
    out = np.ones(len(minimizer), bool)
    for row in range(SKETCH_ROWS):
        cell = _cells(minimizer, row, log2)
        out &= (bits[row, (cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


class _Seen:
    """Windows that several documents of a chunk held, with the least document that the task has sent on for each."""

    def __init__(self) -> None:
        self.hash, self.second, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def earlier(self, h: np.ndarray, s: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows by rising h, with their least and greatest documents in a chunk: the least document sent before (or the greatest number), and whether the window has to be sent on."""
        before = np.full(len(h), np.iinfo(np.int64).max)
        if len(self.hash) and len(h):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            known = (self.hash[at] == h) & (self.second[at] == s)
            before[known] = self.least[at[known]]
            self.least[at[known]] = np.minimum(self.least[at[known]], least[known])
        fresh = least < before
        room = REMEMBERED - len(self.hash)
        alone = np.ones(len(h), bool)
        alone[1:] = h[1:] != h[:-1]
        add = np.flatnonzero((most > least) & alone & (before == np.iinfo(np.int64).max))
        if len(self.hash) and len(add):
            at = np.minimum(np.searchsorted(self.hash, h[add]), len(self.hash) - 1)
            add = add[self.hash[at] != h[add]]
        add = add[:room]
        if len(add):
            order = np.argsort(both := np.concatenate([self.hash, h[add]]), kind="stable")
            self.hash, self.second, self.least = both[order], np.concatenate([self.second, s[add]])[order], np.concatenate([self.least, least[add]])[order]
        return before, fresh


_FOUND = "hash long, second long, doc_id long, text_hash long, places binary"
_FOUND_ARROW = pa.schema([("hash", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.binary())])


def _find(shared, log2: int):  # noqa: ANN001, ANN202
    """Candidate windows. Those with an earlier document in the chunk, or in an earlier chunk of the task if the window is
    remembered, are settled here and go out as places by document; of the others, one row (hash, second, doc_id) a chunk
    and window goes out to be compared across chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen = _Seen()
        for chunk in _chunks(batches):
            t = _Texts(chunk)
            step = np.ones(len(t.minimizer), bool)  # a minimizer mostly serves several windows in a row
            step[1:] = t.minimizer[1:] != t.minimizer[:-1]
            group = np.cumsum(step) - 1
            keep = np.flatnonzero(_repeated(bits, t.minimizer[step], log2)[group] & t.known)
            h, s, owner, place = t.hashes(keep, 1), t.hashes(keep, 2), t.owner[keep], t.position(keep)
            t.release()
            doc = t.doc_id[owner]
            order = np.lexsort((doc, s, h))
            h, s, doc, owner, place = h[order], s[order], doc[order], owner[order], place[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(new)
            window = np.cumsum(new) - 1
            before, fresh = seen.earlier(h[first], s[first], doc[first], doc[np.append(first[1:], len(h)) - 1] if len(h) else doc)
            late = doc > np.minimum(doc[first], before)[window] if len(h) else np.zeros(0, bool)
            sent = first[fresh]
            for a in range(0, len(sent), 1 << 16):
                at = sent[a : a + (1 << 16)]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(s[at].view(np.int64)), pa.array(doc[at]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_FOUND_ARROW)
            if late.any():
                owner, place = owner[late], place[late].astype(np.uint32)
                order = np.lexsort((place, owner))
                owner, place = owner[order], place[order]
                bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=-2))
                texts = pa.Table.from_batches(chunk).column("text_hash").to_pylist()
                rows = [(int(owner[a]), pa.compress(np.diff(place[a:b], prepend=np.uint32(0)).tobytes(), "zstd", asbytes=True), b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                blobs = [int(n).to_bytes(4, "little") + x for _, x, n in rows]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(t.doc_id[[r[0] for r in rows]]), pa.array([texts[r[0]] for r in rows], pa.int64()), pa.array(blobs, pa.binary())], schema=_FOUND_ARROW
                )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gl_row with gl_text, the kept words where any goes and else null, gl_words and gl_removed."""
    for batch in batches:
        text = pc.struct_field(batch.column("gl_row"), "text")
        raw, offsets = utf8(text)
        starts, ends, first = word_spans(raw, offsets)
        count = np.diff(first)
        late, places, text_hash = batch.column("gl_hashes"), batch.column("gl_places"), batch.column("gl_text_hash").to_pylist()
        marked = np.flatnonzero(np.asarray(late.is_valid()) | np.asarray(places.is_valid()))
        kept, removed = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
        for i in marked.tolist():
            n = int(count[i])
            if n < WINDOW:
                continue
            hit = np.zeros(n - WINDOW + 1, bool)
            if late[i].is_valid and len(late[i].values):
                own = word_hashes(raw, starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])
                hit |= np.isin(grams(own, WINDOW, seed=1), np.asarray(late[i].values).view(np.uint64))
            for x in places[i].as_py() or ():
                if x["text_hash"] == text_hash[i]:
                    data = pa.decompress(x["places"][4:], 4 * int.from_bytes(x["places"][:4], "little"), "zstd", asbytes=True)
                    hit[np.cumsum(np.frombuffer(data, np.uint32))] = True
            edge = np.zeros(n + 1, np.int32)
            edge[:-WINDOW] += hit
            edge[WINDOW:] -= hit
            gone = np.cumsum(edge[:-1]) > 0
            removed[i] = int(gone.sum())
            if removed[i]:
                kept[i] = b" ".join(compress(text[i].as_py().encode().split(), (~gone).tolist())).decode()
        yield pa.RecordBatch.from_arrays([batch.column("gl_row"), pa.array(kept, pa.string()), pa.array(count), pa.array(removed)], names=["gl_row", "gl_text", "gl_words", "gl_removed"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents without the words covered by a window of WINDOW words that also starts in a document of smaller doc_id.

    Returns the columns of documents, text holding the kept words joined by one space where any was removed (else
    unchanged), with gl_words and gl_removed: the numbers of words and of removed ones. See judged for the cases.
    """
    return judged(documents).select("gl_row.*", "gl_words", "gl_removed")


def judged(documents: DataFrame) -> DataFrame:
    """(gl_row, gl_words, gl_removed): the rows of remove_repeats as structs, so that no column's name can clash.

    Windows are judged on the input. Defined cases: a null text has no words and stays null; documents of a null
    doc_id neither lose words nor make others lose any; rows that share a doc_id are one document, none earlier than
    another; texts below WINDOW words stay; texts of any length are judged whole; repeated rows lose the same words;
    columns pass through, whatever their names; an empty table stays empty.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = size / 6 * 2 / (WINDOW - CORE + 2)  # words of six bytes; two in seven windows bring a new minimizer
    log2 = min(MAX_LOG2_CELLS, max(MIN_LOG2_CELLS, math.ceil(math.log2(4 * items + 1))))
    log2 = max(log2, SLICE_BITS)

    partial = rows.mapInArrow(_sketch(log2), "slice long, hits binary")
    merged = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice long, bits binary")
    bits = np.zeros((SKETCH_ROWS, 1 << (log2 - 3)), np.uint8)
    width = 1 << (SLICE_BITS - 3)
    for r in merged.collect():  # the merged sketch: at most SKETCH_ROWS * 2**MAX_LOG2_CELLS bits
        at = (r["slice"] & 0xFFFFFFFF) * width
        bits[r["slice"] >> 32, at : at + width] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    del bits

    text_hash = F.xxhash64("text")
    found = rows.withColumn("text_hash", text_hash).mapInArrow(_find(shared, log2), _FOUND)
    # Places that are settled go through the same exchange, each as a group of its own, so that the windows are found once.
    found = found.withColumn("settled", F.col("places").isNotNull()).withColumn("hash", F.coalesce("hash", "text_hash")).withColumn("second", F.coalesce("second", "doc_id"))
    first = F.min("doc_id").over(Window.partitionBy("hash", "second", "settled"))  # at most a row a chunk and window, and mostly a row a task where many documents hold it
    late = found.withColumn("first", first).filter("settled OR doc_id > first")
    marks = late.groupBy(F.col("doc_id").alias("gl_doc_id")).agg(
        F.collect_list(F.when(~F.col("settled"), F.col("hash"))).alias("gl_hashes"), F.collect_list(F.when(F.col("settled"), F.struct("text_hash", "places"))).alias("gl_places")
    )

    rows = packed(documents)
    joined = rows.withColumn("gl_text_hash", F.xxhash64("gl_row.text")).join(marks, F.col("gl_row.doc_id") == F.col("gl_doc_id"), "left")
    out = T.StructType([*rows.schema, T.StructField("gl_text", T.StringType()), T.StructField("gl_words", T.LongType()), T.StructField("gl_removed", T.LongType())])
    found = joined.mapInArrow(_remove, out)
    return found.select(F.col("gl_row").withField("text", F.coalesce("gl_text", "gl_row.text")).alias("gl_row"), "gl_words", "gl_removed")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document after remove_repeats."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("gl_words"), "n_removed": batch.column("gl_removed"), "kept_sha256": pa.array(sums, pa.string())})

    return remove_repeats(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM w
), h AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS window_words FROM g
), r AS (
  SELECT doc_id, pos FROM h QUALIFY doc_id > min(doc_id) OVER (PARTITION BY window_words)
), c AS (
  SELECT doc_id, list(DISTINCT pos + k) AS gone FROM r, (SELECT unnest(range(13)) AS k) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id
), t AS (
  SELECT k.doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, len(gone) AS n_gone, words, gone FROM k
)
SELECT doc_id, n_words, n_removed,
  sha256(array_to_string(CASE WHEN n_gone = 0 THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
    lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM t
"""
