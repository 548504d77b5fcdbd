"""Exact top-k inner-product search by no-random-access aggregation.

Within a block of vectors, each dimension is a list sorted by value, read from the top where the query's component is
positive and from the bottom where it is negative. The lists are read on from depth to depth. What was read of a
vector plus the lists' frontiers bounds its score from above, and plus the lists' ends from below. A vector whose
upper bound lies under the k-th best lower bound (or the k-th best score of earlier blocks) is out; a query stops when
no outsider can qualify, and its lists are read on for the others alone, to the ends, which gives their final scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, shared_dir, small_batches

K = 5
SCALE = 256
#: Queries that a pass over the vectors answers; a block of them is what the driver holds and sends out.
QUERY_BLOCK = 4096
#: Vectors in a block of sorted lists, and queries in one step over it.
ROWS, STEP = 2048, 512
#: Shares of each list after which bounds are compared.
DEPTHS = (0.5, 0.7, 0.85, 0.95, 1.0)
#: From this share of open (vector, query) pairs down, lists are read on for the open pairs alone, so many at once.
SPARSE, PAIRS = 1 / 6, 16384
_PARTIAL = "query int, vec_id long, score long, key binary"
_ARROW = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, floor(SCALE * x) of all components as doubles) of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(SCALE * np.asarray(column.flatten().cast(pa.float64())))
    return np.diff(np.asarray(column.offsets)), values


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.rows = k, np.zeros((3, 0))
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = (np.concatenate(x) for x in zip(self.held(), (query, ids, score), strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        begins = np.searchsorted(q, q)
        rank = np.arange(len(q)) - begins
        keep = rank < self.k
        self._q, self._i, self._s = q[keep], i[keep], s[keep]
        full = self._q[rank[keep] == self.k - 1]
        self.least[full] = self._s[rank[keep] == self.k - 1]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_q"):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return self._q, self._i, self._s


def search_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, numbers: np.ndarray, best: Best) -> int:
    """Bring the vectors x of one length into best, for queries of that length; numbers: the queries' places in best.

    Returns how many (vector, query) pairs were open when the lists' ends were reached.
    """
    n, dims = x.shape
    k, ended = best.k, 0
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape).copy(), axis=0)
    ordered = np.take_along_axis(x, order, axis=0)
    depths = sorted({max(1, min(n, int(np.ceil(d * n)))) for d in DEPTHS})
    steps, since = [], 0
    for depth in depths:  # what is read between two depths, from the top and from the bottom, and what is not read yet
        up, down = n - 1 - place, place
        fresh = np.hstack([np.where((up >= since) & (up < depth), x, 0), np.where((down >= since) & (down < depth), x, 0)])
        unread = np.hstack([up >= depth, down >= depth]).astype(np.float64)
        steps.append((fresh, unread, np.concatenate([ordered[n - depth], ordered[depth - 1]])))
        since = depth
    floor = np.concatenate([ordered[0], ordered[-1]])
    for a in range(0, len(queries), STEP):
        q, at = queries[a : a + STEP], numbers[a : a + STEP]
        signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).T
        other = ids[:, None] != query_ids[a : a + STEP][None]
        bar = best.least[at].copy()
        score, i, j = np.zeros((n, len(q))), None, None
        for s, (fresh, unread, frontier) in enumerate(steps):
            last = s == len(steps) - 1
            if i is None:
                score += fresh @ signed
                if not last:
                    if n > k and np.isinf(bar).any():
                        lower = np.where(other, score + unread @ (signed * floor[:, None]), -np.inf)
                        bar = np.maximum(bar, np.partition(lower, n - k, axis=0)[n - k])
                    open_ = other & (score + unread @ (signed * frontier[:, None]) >= bar)
                    if open_.mean() <= SPARSE:
                        i, j = np.nonzero(open_)
                        score = score[i, j]
                else:
                    i, j = np.nonzero(other & (score >= bar))
                    score = score[i, j]
                    ended += len(i)
                continue
            keep = np.ones(len(i), bool)
            for b in range(0, len(i), PAIRS):
                part = slice(b, b + PAIRS)
                mine = signed[:, j[part]].T
                score[part] += np.einsum("ij,ij->i", fresh[i[part]], mine)
                if not last:
                    keep[part] = score[part] + np.einsum("ij,ij->i", unread[i[part]], mine * frontier) >= bar[j[part]]
            ended += len(i) if last else 0
            i, j, score = i[keep], j[keep], score[keep]
            if not len(i):
                break  # no outsider can qualify
        good = score >= bar[j]
        best.add(at[j[good]], ids[i[good]], score[good])
    return ended


class Large:
    """The k best of each query among pairs whose products doubles don't add exactly: whole numbers of any size."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def add(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, numbers: np.ndarray) -> None:
        whole = np.array([[int(v) for v in row] for row in x], dtype=object)
        for q, own, at in zip(queries, query_ids, numbers.tolist(), strict=True):
            scores = whole @ np.array([int(v) for v in q], dtype=object)
            held = self.rows.get(at, []) + [(-s, v) for s, v in zip(scores.tolist(), ids.tolist(), strict=True) if v != own]
            self.rows[at] = sorted(held)[: self.k]


def score_key(score: int) -> bytes:
    """Bytes that sort as the numbers do, of any size."""
    size = max(1, (abs(score).bit_length() + 7) // 8)
    data = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + data if score >= 0 else b"\x00" + bytes(255 - v for v in data)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """For each row of vectors(vec_id, embedding) that is_query selects, its k highest integer inner products.

    Returns query_id, rank (from 1), vec_id, score; components count as floor(256 * x). Ties go to the smaller
    vec_id. All rows but those of the query's own vec_id are candidates. Queries are answered in blocks of
    QUERY_BLOCK, each one pass over all rows; a task keeps k rows a query, which then meet by query. Blocks beyond the
    first are run one by one into the shared folder, so that the driver holds one. Defined cases: unusable vectors
    (see usable) and null vec_ids take no part; vectors meet only those of their own length; a repeated row is a
    candidate as often as it occurs, and a query once; other columns are ignored, whatever their names; scores and
    their order are exact at any size, but a score beyond 64 bits is returned as the bound; empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = rows.filter("is_query").select("vec_id", "embedding").distinct()
    count = asked.count()
    blocks = -(-count // QUERY_BLOCK) if count <= QUERY_BLOCK else -(-count // (QUERY_BLOCK * 3 // 4))
    rows = rows.select("vec_id", "embedding")
    if blocks <= 1:
        return _pass(rows, asked.toArrow(), k)
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"), "topk-asked")
    folder = f"{shared_dir(spark)}/graphloom/topk-{uuid.uuid4().hex}"
    for b in range(blocks):
        held = asked.filter(F.col("block") == b).select("vec_id", "embedding").toArrow()
        _pass(rows, held, k).write.mode("append").parquet(folder)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)


def _pass(rows: DataFrame, held: pa.Table, k: int) -> DataFrame:
    held = held.sort_by("vec_id")
    query_ids = np.asarray(held.column("vec_id"))
    lengths, values = _matrix(held.column("embedding")) if held.num_rows else (np.zeros(0, np.int64), np.zeros(0))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    matrices = {n: np.stack([values[begins[i] : begins[i] + n] for i in own]) for n, own in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, large, waiting = Best(len(query_ids), k), Large(k), {}

        def search(n: int) -> None:
            x, ids = (np.concatenate(c) for c in zip(*waiting.pop(n), strict=True))
            q, own, bound = matrices[n], by_length[n], np.sqrt(2.0**53 / n)  # doubles add products of components up to the bound exactly
            fit, q_fit = np.abs(x).max(axis=1) <= bound, np.abs(q).max(axis=1) <= bound
            if fit.any() and q_fit.any():
                search_block(x[fit], ids[fit], q[q_fit], query_ids[own[q_fit]], own[q_fit], best)
            if not fit.all():
                large.add(x[~fit], ids[~fit], q, query_ids[own], own)
            if not q_fit.all() and fit.any():
                large.add(x[fit], ids[fit], q[~q_fit], query_ids[own[~q_fit]], own[~q_fit])

        for batch in batches:
            sizes, flat = _matrix(batch.column("embedding"))
            ids, at = np.asarray(batch.column("vec_id")), np.concatenate(([0], np.cumsum(sizes)))
            for n in np.unique(sizes).tolist():
                if n in matrices:
                    own = np.flatnonzero(sizes == n)
                    x = flat.reshape(-1, n) if len(own) == len(sizes) else np.stack([flat[at[i] : at[i] + n] for i in own])
                    waiting.setdefault(n, []).append((x, ids[own]))
                    if sum(len(c[1]) for c in waiting[n]) >= ROWS:
                        search(n)
        for n in list(waiting):
            search(n)
        q, i, s = best.held()
        found = list(zip(q.tolist(), i.tolist(), map(int, s.tolist()), strict=True)) + [(q, v, -s) for q, top in large.rows.items() for s, v in top]
        clamp = lambda v: max(-(2**63), min(v, 2**63 - 1))
        columns = [[f[0] for f in found], [f[1] for f in found], [clamp(f[2]) for f in found], [score_key(f[2]) for f in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    met = rows.mapInArrow(run, _PARTIAL)
    order = Window.partitionBy("query").orderBy(F.desc("key"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = rows.sparkSession.createDataFrame(pa.table({"query": pa.array(np.arange(len(query_ids)), pa.int32()), "query_id": pa.array(query_ids, pa.int64())}))
    return ranked.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")  # at most QUERY_BLOCK pairs of numbers


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
