"""Packing of token streams into sequences of bounded length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import small_batches
from graphloom.llm.tokens import default_vocabulary, tokenizer

CAPACITY = 2048
END_ID = 1
#: Tokens of a group that is packed together; groups never span tasks, so each task leaves one smaller group.
GROUP_TOKENS = 256 * CAPACITY
#: Documents of a group at most, so that a group of short ones is bounded too.
GROUP_DOCUMENTS = 1 << 16
#: Documents' rests longer than this are cut once, so that two of them fit a sequence.
COARSE = CAPACITY // 2
#: Of each group's documents, those that hold this share of the rests' tokens are cut into FINE pieces, with which differencing evens the sequences out.
FINE_SHARE, FINE = 0.06, 32
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE_SCHEMA.split(", ")])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k sets of near-equal sums (Karmarkar-Karp, largest differencing first).

    A partial partition is k sums, least sum subtracted, with a node of items at each. The two partitions of the
    largest spreads are merged again and again, the larger sums of one onto the smaller sums of the other.
    """
    left, right = [], []  # inner nodes: len(sizes), len(sizes) + 1, ...
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, sums2, nodes2 = heapq.heappop(heap)
        sums2, nodes2 = sums2[::-1], nodes2[::-1]
        sums = sums + sums2
        both = np.flatnonzero((nodes >= 0) & (nodes2 >= 0))
        joined = np.maximum(nodes, nodes2)
        if len(both):
            base = len(sizes) + len(left)
            left += nodes[both].tolist()
            right += nodes2[both].tolist()
            joined[both] = np.arange(base, base + len(both))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], joined[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, nodes))
        serial += 1
    out: list[list[int]] = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < len(sizes):
                items.append(x)
            else:
                stack += (left[x - len(sizes)], right[x - len(sizes)])
        out.append(sorted(items))
    return out


def cut(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(full, rest): pieces (document, start, length) of exactly the capacity, and the others."""
    full, rest = [], []
    left = [n % capacity for n in lengths]
    fine, share = set(), FINE_SHARE * sum(left)
    for i in sorted(range(len(left)), key=lambda i: (-left[i], i)):  # the longest: fewest documents are cut small
        if share <= 0:
            break
        fine.add(i)
        share -= left[i]
    for i, n in enumerate(lengths):
        full += [(i, a, capacity) for a in range(0, n - capacity + 1, capacity)]
        at = n - left[i]
        step = max(1, FINE * capacity // CAPACITY) if i in fine else max(1, COARSE * capacity // CAPACITY)
        while at < n:
            rest.append((i, at, min(step, n - at)))
            at += step
    return full, rest


def units(lengths: list[int], least: int) -> list[list[int]]:
    """Items put together, in order, until each unit but the last has the least length: differencing holds two rows of numbers a unit, however short the items are."""
    out, open_, size = [], [], 0
    for i, n in enumerate(lengths):
        if n >= least:
            out.append([i])
            continue
        open_.append(i)
        size += n
        if size >= least:
            out.append(open_)
            open_, size = [], 0
    return [*out, open_] if open_ else out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), none longer than the capacity, that hold every token once."""
    full, rest = cut(lengths, capacity)
    sequences = [[x] for x in full]
    joined = units([x[2] for x in rest], max(1, FINE * capacity // CAPACITY))
    sizes = [sum(rest[i][2] for i in u) for u in joined]
    total = sum(sizes)
    k = -(-total // capacity)
    while rest:
        sets = difference(sizes, k)
        most = max(sum(sizes[u] for u in s) for s in sets)
        if most <= capacity:
            sequences += [[rest[i] for u in s for i in joined[u]] for s in sets if s]
            break
        over = most - -(-total // k)  # the count rises to where the same imbalance would fit
        k = max(k + 1, -(-total // max(1, capacity - over)) if over < capacity // 8 else k + 1)
    return sequences


def pack_documents(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack the rows of documents(doc_id, text) into sequences of at most capacity tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (PIECE_SCHEMA). A
    document is the ids of its text and end_id; a null or empty text is end_id alone. Full-length pieces are sequences
    of their own; the rests are packed in groups of GROUP_TOKENS, or of GROUP_DOCUMENTS documents, by differencing, and a group takes one more sequence
    while any exceeds the capacity. Nothing is shuffled: a task packs what it reads, so sequence ids are a task's
    number and a counter. Defined cases: a null doc_id stays null; repeated rows are packed each on its own; ties
    fall to the earlier row; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, t = TaskContext.get().partitionId() << 40, tokenizer(path)
        end = end_id.to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths, rows = [len(ids) // 4 for _, ids in held], []
            for pieces in pack(lengths, capacity):
                offset = 0
                for i, start, length in pieces:
                    rows.append((held[i][0], start, length, zlib.crc32(memoryview(held[i][1])[4 * start : 4 * (start + length)]), lengths[i], sequence, offset))
                    offset += length
                sequence += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.append((doc_id, t.ids(text.as_py()) + end))
                tokens += len(held[-1][1]) // 4
                if tokens >= GROUP_TOKENS or len(held) >= GROUP_DOCUMENTS:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)
