"""Vector codes by product quantisation in whole numbers.

Vectors are cut into parts; each part position has a codebook, refined round by round. The kept vectors are written
once as columnar blocks (a row of numbers for each dimension). A round is one RDD treeAggregate over the blocks:
distances to all entries of a codebook accumulate dimension by dimension, np.add.at adds up each entry's parts in
tensors of sums and counts, and these merge through a reduction tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, small, small_batches
from graphloom.llm.topk import usable

#: Units in 1.0 of a component, parts of a vector, entries of a codebook, and rounds that refine the codebooks (fixed values).
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of up to so many bits go by 64-bit numbers (a part of up to 2^19 of them has an exact distance); beyond, by Python's, without bounds.
SMALL_BITS = 20
#: Numbers in a block: 4,096 vectors of 64 dimensions.
BLOCK_NUMBERS = 1 << 18
MOST_LONG = (1 << 63) - 1
_BLOCKS = "n int, dims int, width int, data binary, ids array<long>, labels array<string>"
_ARROW = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each value, as 64-bit numbers, or as Python's where a value is too large for exact distances."""
    with np.errstate(over="ignore"):
        floored = np.floor(values * float(scale))
    if not floored.size or np.abs(floored).max() < 1 << SMALL_BITS:
        return floored.astype(np.int64)
    return np.array([int(np.floor(x)) if np.isfinite(x) else scale * int(y) for x, y in zip(floored.ravel().tolist(), values.ravel().tolist(), strict=True)], dtype=object).reshape(values.shape)


def packed_numbers(columns: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, data) of whole numbers (dimensions x rows), as narrow as they fit."""
    if columns.dtype == object:
        width = max(int(x).bit_length() for x in columns.ravel()) // 8 + 1
        return width, b"".join(int(x).to_bytes(width, "little", signed=True) for x in columns.ravel())
    width = 2 if not columns.size or -(1 << 15) <= columns.min() and columns.max() < 1 << 15 else 4
    return width, np.ascontiguousarray(columns).astype(f"<i{width}").tobytes()


def unpacked_numbers(width: int, data: bytes, dims: int) -> np.ndarray:
    """(dimensions x rows): the reverse of packed_numbers."""
    if width in (2, 4):
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(dims, -1)
    return np.array([int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)], dtype=object).reshape(dims, -1)


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part in columns (dimensions x rows): the nearest of entries (entries x dimensions), ties to the lower index."""
    distance = np.zeros((columns.shape[1], len(entries)), np.result_type(columns, entries))
    for column, own in zip(columns, entries.T, strict=True):
        gap = column[:, None] - own[None, :]
        distance += gap * gap
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(best)), best]


def part(columns: np.ndarray, p: int, parts: int) -> np.ndarray:
    size = len(columns) // parts
    return columns[p * size : (p + 1) * size]


def sums_and_counts(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For books (parts x entries x dimensions): componentwise sums of the parts that each entry is nearest to, and their number."""
    sums, counts = np.zeros(books.shape, np.result_type(columns, books)), np.zeros(books.shape[:2], np.int64)
    for p in range(len(books)):
        own = part(columns, p, len(books))
        best, _ = nearest(own, books[p])
        np.add.at(sums[p], best, own.T)
        np.add.at(counts[p], best, 1)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floor(sum / count) by component; unused entries stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _fits(vectors: DataFrame, parts: int) -> DataFrame:
    return vectors.filter(usable(F.col("gl_vector")) & (F.size("gl_vector") % parts == 0))


def blocks(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """(_BLOCKS) written to the shared folder: vectors(gl_id, gl_label, gl_vector) of dims dimensions, columnar, BLOCK_NUMBERS a block."""
    most = max(1, BLOCK_NUMBERS // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            values = t.column("gl_vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width, data = packed_numbers(whole(values.reshape(-1, dims), scale).T)
            ids, labels = (t.column(c).to_pylist() for c in ("gl_id", "gl_label"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((len(ids), dims, width, data, ids, labels), _ARROW, strict=True)], schema=_ARROW)

        n = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                batch = batch.slice(held[-1].num_rows)
                n += held[-1].num_rows
                if n >= most:
                    yield block()
                    n = 0
        if n:
            yield block()

    return materialize(vectors.select("gl_id", "gl_label", "gl_vector").mapInArrow(run, _BLOCKS), "vector-blocks", "zstd")


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """(parts x entries x dimensions): the parts of the vectors of the smallest ids, ties by the vector, null ids last; fewer entries where there are fewer vectors."""
    rows = vectors.select("gl_id", "gl_vector").orderBy(F.asc_nulls_last("gl_id"), "gl_vector").limit(entries).collect()
    first = whole(np.array([r.gl_vector for r in rows], dtype=np.float64), scale)
    return np.stack(np.split(first, parts, axis=1))


def refined(table: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds over the blocks."""
    data = table.select("dims", "width", "data").rdd
    for _ in range(rounds):
        zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))

        def add(total: tuple[np.ndarray, np.ndarray], row: tuple, books: np.ndarray = books) -> tuple[np.ndarray, np.ndarray]:
            return merge(total, sums_and_counts(unpacked_numbers(row[1], bytes(row[2]), row[0]), books))

        def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return a[0] + b[0], a[1] + b[1]

        books = moved(books, *data.treeAggregate(zero, add, merge))
    return books


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector of the blocks: two hex digits a part, and squared distances over all parts (up to MOST_LONG)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = unpacked_numbers(row["width"], row["data"], row["dims"])
                found = [nearest(part(columns, p, len(books)), book) for p, book in enumerate(books)]
                digits = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                error = [min(int(x), MOST_LONG) for x in sum(d for _, d in found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([d.tobytes().hex() for d in digits]), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return table.select("dims", "width", "data", "ids", "labels").mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(codes, codebooks) of embeddings(vec_id, embedding, label); codes: vec_id, label, code, error of each kept row.

    Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are vectors
    that cannot be cut into equal parts and those of another length than the vector of the smallest id; a null vec_id
    comes after all others and stays null; repeated rows and ids are coded each on its own, and start codebooks each on
    its own; components of any size are exact (an error beyond 64 bits is returned as the largest); other columns are
    ignored, whatever their names; where nothing is kept, there are no codes and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: from 1 to 256 entries")
    small_batches(embeddings.sparkSession)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("gl_id"), F.col("label").cast("string").alias("gl_label"), F.col("embedding").cast("array<double>").alias("gl_vector"))
    vectors = _fits(vectors, parts)
    least = vectors.select(F.size("gl_vector").alias("dims"), "gl_id", "gl_vector").orderBy(F.asc_nulls_last("gl_id"), "gl_vector").select("dims").head()
    if least is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), None
    vectors = vectors.filter(F.size("gl_vector") == least.dims)
    table = blocks(vectors, least.dims, scale)
    books = refined(table, first_books(vectors, parts, entries, scale), rounds)
    return coded(table, books), books


def compress(embeddings: DataFrame, **options: int) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of embeddings; see encode.

    label_error sums the errors of equal labels, nulls together (up to MOST_LONG).
    """
    codes, books = encode(embeddings, **options)
    codes = materialize(codes, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    by_label = codes.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    out = codes.join(small(by_label), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(None if books is None else digest(books)).cast("string").alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with vector (array<double>): the entries that a code names, in the units of the embeddings."""
    table = [[[float(x) / scale for x in entry] for entry in book] for book in books.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for book, k in zip(table, bytes.fromhex(code), strict=True) for x in book[k]] for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in codes.dtypes) + ", vector array<double>")


def _sql() -> str:
    """The rounds one by one, over a row for each vector and part (lists as parts)."""
    gap = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    head = f"""
kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT row, vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)
), starts AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}
), book0 AS (
  SELECT p, e, x FROM cut JOIN starts USING (row)
)"""
    steps = [head]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT row, p, min((d, e)) AS best, any_value(x) AS x FROM (SELECT a.row, a.p, a.x, b.e, {gap} AS d FROM cut AS a JOIN book{k} AS b ON a.p = b.p) GROUP BY row, p)")
        if k < ROUNDS:
            mean = f"SELECT p, best[2] AS e, i, floor_div(sum(x[i])::BIGINT, count(*)) AS m FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY ALL".replace("floor_div(sum(x[i])::BIGINT, count(*))", "((sum(x[i])::BIGINT - ((sum(x[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} AS b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM ({mean}) GROUP BY p, e) AS m ON b.p = m.p AND b.e = m.e)")
    last = f"near{ROUNDS}"
    return f"""
WITH {", ".join(steps)}, codes AS (
  SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM {last} GROUP BY row
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (row), books"""


SQL = _sql()
