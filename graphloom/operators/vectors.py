"""Chunks of text, their embeddings, and exact nearest-neighbour retrieval that leaves out a function's own lines."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.generation import GenerationError
from graphloom.storage import bounded_batches

MAX_LINES, MAX_CHARS = 12, 500
EMBED_BATCH = 64
OVERFETCH, KEEP = 20, 5
#: Most rows of a block in nearest(): a task holds two blocks and a tile of distances. Blocks of tables below are as many as keep all cores busy, of SPREAD rows at least.
BLOCK, SPREAD = 1 << 16, 2048
#: Queries and rows of a tile.
TILE = 128, 2048


def chunk_lines(lines: list[str], max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int, str]]:
    """(start, end, text): runs of up to max_lines lines within max_chars; a line beyond that alone is cut into pieces."""
    held: list[str] = []
    used, start = 0, 0
    for i, line in enumerate([*lines, None]):
        size = max_chars + 1 if line is None else len(line) + 1
        if held and (len(held) == max_lines or used + size > max_chars):
            if (text := "\n".join(held)).strip():
                yield start, i, text
            held, used = [], 0
        if line is None:
            break
        if size > max_chars:
            yield from ((i, i + 1, piece) for at in range(0, len(line), max_chars) if (piece := line[at : at + max_chars]).strip())
            continue
        if not held:
            start = i
        held.append(line)
        used += size


def chunk_files(files: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(rel_fname, start_line, end_line, text) of files(rel_fname, content): sequential within a file, parallel across files."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("rel_fname").to_pylist()
            rows = [(name, a, b, t) for name, text in zip(names, batch.column("content").to_pylist(), strict=True) for a, b, t in chunk_lines((text or "").splitlines(), max_lines, max_chars)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["rel_fname", "start_line", "end_line", "text"])

    return files.select("rel_fname", "content").mapInArrow(run, "rel_fname string, start_line int, end_line int, text string")


def hash_embedder(texts: list[str], dims: int = 16) -> list[list[float]]:
    """A deterministic stand-in for a model: numbers from the text's hash."""
    return [[b / 255.0 for b in hashlib.sha256(t.encode()).digest()[:dims]] for t in texts]


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors from an HTTP endpoint that takes a batch of texts as JSON; a failure is a GenerationError of the whole batch."""

    url: str
    model_id: str
    timeout: float = 120.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url, json.dumps({"model": self.model_id, "input": texts}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read().decode())["embeddings"]
        except urllib.error.HTTPError as e:
            raise GenerationError.of(e.code, self.model_id, e.read().decode(errors="replace")) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise GenerationError.of(None, self.model_id, str(e)) from e


def embed_chunks(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = hash_embedder) -> DataFrame:
    """chunks with vector; the embedder gets EMBED_BATCH texts a call and must return as many vectors, in order."""
    size = EMBED_BATCH
    bounded_batches(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for a in range(0, len(f), size):
                texts = f["text"].iloc[a : a + size].tolist()
                got = embedder(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(texts)} texts, but {len(got)} vectors")
                vectors += got
            yield f.assign(vector=vectors)

    fields = ", ".join(f"{n} {t}" for n, t in chunks.dtypes)
    return chunks.mapInPandas(run, f"{fields}, vector array<float>")


def _kept(near: DataFrame, keep: int) -> DataFrame:
    """The keep nearest rows of each query that do not overlap its own lines."""
    order = Window.partitionBy("query").orderBy("distance", "rel_fname", "start_line")
    own = (F.col("rel_fname") == F.col("q_file")) & (F.col("start_line") < F.col("q_end")) & (F.col("end_line") > F.col("q_start"))
    left = near.filter(~own).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return left.select("query", "rank", "rel_fname", "start_line", "end_line", "distance")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    if len(pc.unique(pc.fill_null(pc.list_value_length(column), -1))) > 1 or column.null_count:
        raise ValueError("vectors must not be null and must have one length")
    return pc.cast(column.combine_chunks().flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(rows, -1)


def closest(x: np.ndarray, y: np.ndarray, fetch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): the fetch nearest rows of y for each of x, ties to the first row of y.

    A matrix product tells squared distances up to `slack`. Only the rows within it of the fetch nearest so far are
    measured, in the order of the dimensions as a sum over the array goes, and rounded to nine digits.
    """
    found = []
    with np.errstate(all="ignore"):  # components may be infinite or no numbers; pairs that can't be told are measured
        far = (y * y).sum(1)
        wide = np.column_stack([y, far])
        most, eps = np.max(far, where=np.isfinite(far), initial=0.0), np.finfo(np.float64).eps
        for at in range(0, len(x) if len(y) else 0, TILE[0]):
            part = x[at : at + TILE[0]]
            own, twice = (part * part).sum(1), np.column_stack([-2.0 * part, np.ones(len(part))])
            slack = 8 * (part.shape[1] + 9) * eps * (np.where(np.isfinite(own), own, 0.0) + most) + 2e-9
            bound = np.full(len(part), np.inf)
            rows, columns, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for to in range(0, len(y), TILE[1]):
                some = y[to : to + TILE[1]]
                near = twice @ wide[to : to + TILE[1]].T  # squared distances less the query's own square
                if not to and len(some) >= fetch:
                    bound = np.where(np.isfinite(own), np.partition(near, fetch - 1, axis=1)[:, fetch - 1] + slack, np.inf)
                r, c = np.divmod(np.flatnonzero(~(near > (bound + slack)[:, None])), len(some))
                del near
                for a in range(0, len(r), 1 << 16):
                    p, q = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
                    gap = part[p]
                    gap -= some[q]
                    gap *= gap
                    d = np.zeros(len(p))
                    for k in range(gap.shape[1]):
                        d += gap[:, k]
                    d = np.floor(d * 1e9 + 0.5) / 1e9
                    rows, columns, distance = np.concatenate([rows, p]), np.concatenate([columns, q + to]), np.concatenate([distance, d])
                    order = np.lexsort((columns, distance, rows))
                    rows, columns, distance = rows[order], columns[order], distance[order]
                    first = np.searchsorted(rows, np.arange(len(part)))
                    left = np.arange(len(rows)) - first[rows] < fetch
                    rows, columns, distance = rows[left], columns[left], distance[left]
                full = np.flatnonzero(np.bincount(rows, minlength=len(part)) == fetch)
                last = distance[np.searchsorted(rows, full, side="right") - 1] - own[full] + slack[full]
                bound[full] = np.fmin(bound[full], last)
            found.append((rows + at, columns, distance))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(none, *found, strict=True))


def nearest(queries: DataFrame, vectors: DataFrame, fetch: int = OVERFETCH, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """For each of queries(query, q_file, q_start, q_end, q_vector): the fetch nearest rows of vectors, less those that overlap the query's own lines, of which keep stay.

    Every block of queries meets every block of vectors once, so there may be any number of both.

    A pair of blocks sends the fetch nearest rows of each query on, ties by file and line, so the work is queries x
    vectors and the shuffle each table's rows once a block of the other. Blocks go by hash of row; none holds all.
    """
    bounded_batches(queries.sparkSession)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq, nv = (max(1, -(-n // block), min(-(-n // SPREAD), math.isqrt(4 * cores) + 1)) for n in (queries.count(), vectors.count()))
    own = [F.lit(None).cast(t).alias(n) for n, t in vectors.select("rel_fname", "start_line", "end_line").dtypes]
    none = [F.lit(None).cast(t).alias(n) for n, t in queries.select("query").dtypes]
    q = queries.select("query", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("j"), *own, F.col("q_vector").alias("x"))
    v = vectors.select(*none, F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"), F.pmod(F.xxhash64("rel_fname", "start_line", "end_line"), F.lit(nv)).cast("int").alias("j"), "rel_fname", "start_line", "end_line", F.col("vector").alias("x"))
    types = dict(q.dtypes)
    out = f"query {types['query']}, rel_fname {types['rel_fname']}, start_line {types['start_line']}, end_line {types['end_line']}, distance double"

    def top(met: pa.Table) -> pa.Table:
        asks = pc.is_valid(met.column("query"))
        a, b = met.filter(asks), met.filter(pc.invert(asks)).sort_by([("rel_fname", "ascending"), ("start_line", "ascending")])
        if a.num_rows and b.num_rows:
            rows, columns, far = closest(_matrix(a.column("x"), a.num_rows), _matrix(b.column("x"), b.num_rows), fetch)
        else:
            rows, columns, far = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        hit = b.select(["rel_fname", "start_line", "end_line"]).take(pa.array(columns, pa.int64()))
        return pa.table([a.column("query").take(pa.array(rows, pa.int64())), *hit.columns, pa.array(far, pa.float64())], ["query", "rel_fname", "start_line", "end_line", "distance"])

    # As many partitions as pairs: a pair takes long however few its bytes are, so pairs must not be put together by size.
    met = q.unionByName(v).repartition(max(1, nq * nv), "i", "j").groupBy("i", "j").applyInArrow(top, out)
    order = Window.partitionBy("query").orderBy("distance", "rel_fname", "start_line")
    near = met.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= fetch)
    return _kept(near.join(queries.drop("q_vector"), "query"), keep)


def retrieve(functions: DataFrame, vectors: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = hash_embedder, fetch: int = OVERFETCH, keep: int = KEEP) -> DataFrame:
    """(query, retrieved) of functions(query, rel_fname, start_line, end_line, fn_source): the chunks nearest to the first MAX_CHARS characters of the source.

    retrieved: array<struct<rel_fname, start_line, end_line, text>>, nearest first; functions that find none are left
    out. Chunks that overlap the function's own lines do not count.
    """
    asked = functions.select("query", "rel_fname", "start_line", "end_line", F.substring("fn_source", 1, MAX_CHARS).alias("text"))
    asked = embed_chunks(asked, embedder).select("query", F.col("rel_fname").alias("q_file"), F.col("start_line").alias("q_start"), F.col("end_line").alias("q_end"), F.col("vector").alias("q_vector"))
    near = nearest(asked, vectors, fetch, keep)
    hit = near.join(vectors.select("rel_fname", "start_line", "end_line", "text"), ["rel_fname", "start_line", "end_line"])
    chunk = F.struct("rank", "text", F.struct("rel_fname", "start_line", "end_line", "text").alias("c"))
    best = F.slice(F.sort_array(F.collect_list(chunk)), 1, keep)
    return hit.groupBy("query").agg(F.transform(best, lambda x: x["c"]).alias("retrieved"))
