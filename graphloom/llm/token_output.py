"""Token-id matrices: best-fit-decreasing packing, with cumulative segment lengths and position resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches
from graphloom.llm.tokens import default_vocabulary, tokenizer

CAPACITY = 2048
#: The vocabulary's end-of-text id, after each document.
END_ID = 50256
PAD_ID = 50256
#: Tokens, and documents at most, of a group that is packed together.
GROUP_TOKENS, GROUP_DOCUMENTS = 1024 * CAPACITY, 1 << 17
ROW_SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many bins have each; finds the least one that suffices."""

    def __init__(self, top: int) -> None:
        self.width = 1 << (top + 1).bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        x = capacity + self.width
        while x:
            self.count[x] += n
            x >>= 1

    def least(self, need: int) -> int | None:
        """The least capacity of need or more that a bin has."""
        x, count = need + self.width, self.count
        if count[x]:
            return need
        while x > 1:  # up, until a right neighbour holds a bin
            if not x & 1 and count[x + 1]:
                x += 1
                while x < self.width:
                    x = 2 * x if count[2 * x] else 2 * x + 1
                return x - self.width
            x >>= 1
        return None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size (ties: earlier first) into the fullest bin that holds them."""
    tree, open_bins, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room is None:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        open_bins.setdefault(room - sizes[i], []).append(b)
        tree.add(room - sizes[i], 1)
    return bins


def token_matrices(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Rows of a packed id matrix (ROW_SCHEMA) over documents(doc_id, text).

    A document is its ids and end_id; a null or empty text is end_id alone. Documents beyond the capacity are split
    into full rows and a rest, losing no id. Per row: input_ids and position_ids as capacity little-endian 32-bit
    integers (padded with pad_id and 0), positions start anew with each segment, cu_seqlens are the segments' bounds
    from 0, and doc_ids and starts say which ids of which documents the segments hold. Groups of GROUP_TOKENS (or GROUP_DOCUMENTS documents)
    within a task are packed together; nothing is shuffled. Defined cases: null doc_ids stay null in doc_ids; repeated rows are
    segments of their own; ties fall to the earlier row; other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, t, end = TaskContext.get().partitionId() << 40, tokenizer(path), end_id.to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            full, rest = [], []
            for i, (_, ids) in enumerate(held):
                n = len(ids) // 4
                full += [[(i, a, capacity)] for a in range(0, n - capacity + 1, capacity)]
                if n % capacity:
                    rest.append((i, n - n % capacity, n % capacity))
            packed = full + [[rest[j] for j in b] for b in best_fit([x[2] for x in rest], capacity)]
            for at in range(0, len(packed), 256):
                rows = []
                for segments in packed[at : at + 256]:
                    bounds = np.cumsum([0, *(x[2] for x in segments)]).astype("<i4")
                    used = int(bounds[-1])
                    ids = b"".join(memoryview(held[i][1])[4 * a : 4 * (a + n)] for i, a, n in segments) + pad_id.to_bytes(4, "little") * (capacity - used)
                    positions = np.zeros(capacity, "<i4")
                    positions[:used] = np.arange(used) - np.repeat(bounds[:-1], np.diff(bounds))
                    rows.append((sequence, used, [held[i][0] for i, _, _ in segments], [a for _, a, _ in segments], bounds.tolist(), ids, positions.tobytes()))
                    sequence += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.append((doc_id, t.ids(text.as_py()) + end))
                tokens += len(held[-1][1]) // 4
                if tokens >= GROUP_TOKENS or len(held) >= GROUP_DOCUMENTS:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, ROW_SCHEMA)


def write_matrices(documents: DataFrame, path: str, **options: object) -> DataFrame:
    """Write token_matrices(documents, **options) as Parquet files with binary columns; returns the written table."""
    matrices = token_matrices(documents, **options)
    matrices.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(matrices.schema).parquet(path)


def digest_rows(matrices: DataFrame) -> DataFrame:
    """The rows of a written table, as read back, with check sums in place of the two matrices."""
    return matrices.select(
        "sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32")
    )
