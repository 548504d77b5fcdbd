"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in a hashed order, are a stream of words, cut into blocks of equal length. A source draws
whole passes over its blocks and a hashed choice of them for the rest of its target. Its block quota is exact. A
tree then splits the vector of quotas between the halves of the output shards, again and again, by multivariate
hypergeometric draws. Each shard takes its quota from the source's permuted draws, disjoint from the others',
and is shuffled on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, quoted
from graphloom.llm.quality import words_of

#: Weights of the sources in the order of their names (fixed values), the mix's share of all words, and the bound on a source's repeats.
WEIGHTS, SHARE, MOST_REPEATS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a shard, and least number of shards; words of one of the parts, a task each, that a shard is written in.
SHARD_WORDS, LEAST_SHARDS, PART_WORDS = 1 << 26, 16, 1 << 19
#: Blocks of all sources together are at most this many and one more a source: the bound on what the driver plans.
BLOCKS = 1 << 14
#: Least words of a block.
LEAST_BLOCK = 2048
#: Bound on the number of sources, which the driver weighs.
MAX_SOURCES = 100_000
#: Words of all sources for each cell of a source's hashed order, within which a window sums sizes; least number of cells.
CELL_WORDS, LEAST_CELLS = 1 << 24, 1024
#: What tells the rows of the mix apart: a cell of a source's order, and a number in it.
ROW = ["source_no", "cell", "number"]
SEED = 42


def targets(sizes: list[int], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> list[float]:
    """Target words of each source, in the order of sizes. Targets stop at most times a size; the excess is shared anew by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while open_:
        total = sum(open_.values())
        over = [i for i, w in open_.items() if left * w / total >= most * sizes[i]]
        if not over:
            for i, w in open_.items():
                out[i] = left * w / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        for i in over:
            del open_[i]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) counts that add up to quotas, by recursive multivariate hypergeometric halving."""
    if shards == 1:
        return quotas[None]
    half = shards // 2
    n = int(quotas.sum()) * half // shards
    first = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    return np.vstack([split_quotas(first, half, rng), split_quotas(quotas - first, shards - half, rng)])


@dataclass
class Plan:
    block_words: int
    draws: pa.Table  # source_no, block, first, last (words of the source's stream), copy, shard


def shards_for(words: int) -> int:
    """Shards of a mix of so many words; each holds 16 planned blocks or more, and is written in parts of PART_WORDS."""
    return max(LEAST_SHARDS, min(-(-words // SHARD_WORDS), BLOCKS // 16))


def plan(sizes: list[int], wanted: list[int], shards: int = LEAST_SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> Plan:
    """Which words of each source's stream go to which shard; wanted words of each source are met exactly."""
    length = max(LEAST_BLOCK, -(-sum(sizes) // blocks))
    rows = []
    for s, (size, want) in enumerate(zip(sizes, wanted, strict=True)):
        n, copy = -(-size // length), 0
        order = np.random.default_rng([seed, s])
        own = []
        while want > 0 and n:
            for b in order.permutation(n).tolist():
                first, last = b * length, min((b + 1) * length, size)
                last = min(last, first + want)
                want -= last - first
                own.append((s, b, first, last, copy))
                if want <= 0:
                    break
            copy += 1
        rows.append([own[i] for i in order.permutation(len(own))])
    counts = split_quotas(np.array([len(x) for x in rows], dtype=np.int64), shards, np.random.default_rng(seed)) if rows else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(counts, axis=0)
    flat = [(*draw, int(np.searchsorted(ends[:, s], k, side="right"))) for s, own in enumerate(rows) for k, draw in enumerate(own)]
    names = ("source_no", "block", "first", "last", "copy", "shard")
    columns = list(zip(*flat, strict=True)) if flat else [[]] * len(names)
    return Plan(length, pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))


def _seeded(seed: int, *columns: str):  # noqa: ANN202
    return F.xxhash64(F.lit(seed), *columns)


def row_identity(documents: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by all of their columns, nulls included, as two numbers."""
    plain = [F.to_json(F.struct(F.col(quoted(c)).alias("x")), {"ignoreNullFields": "false"}) if re.match("array|map|struct", t) else F.col(quoted(c)) for c, t in documents.dtypes]
    marked = [x for c in plain for x in (c.isNull(), c)]
    return F.xxhash64(*marked), F.xxhash64(F.lit(20_011), *marked)


def draw(documents: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """(rows, pieces, words) of a mix of documents(doc_id, text, source).

    rows: ROW, doc_id, h1, h2 (the row's identity, of all its columns), size, source_size, target of each row. pieces: ROW, doc_id, h1, h2,
    shard, place (the shuffled order in the shard), copy, first, last: words [first, last) of a row that the mix
    takes. words: of the whole mix. shards: shards_for(words) by default. A document cut by a block's edge gives
    several pieces. Sources are ordered by code point, null last. Defined cases: a null or empty text has size 0 and
    no pieces; texts of any length are counted whole; rows repeated in every column are told apart only by
    number, and share the order; a table of no words gives no pieces; ties in the hashed order fall to the smaller
    doc_id; reruns agree; other columns may have any names and only
    tell rows apart.
    """
    spark = documents.sparkSession
    h1, h2 = row_identity(documents)
    rows = documents.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), h1.alias("h1"), h2.alias("h2"))
    rows = counted = materialize(rows, "mix-rows")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per_source]
    goal = targets(sizes, share, weights, most)
    wanted = [min(round(t), int(most * s)) for t, s in zip(goal, sizes, strict=True)]
    planned = plan(sizes, wanted, shards or shards_for(sum(wanted)), seed=seed)

    table = pa.table(
        {
            "source": pa.array([r["source"] for r in per_source], pa.string()), "source_no": pa.array(range(len(sizes)), pa.int64()),
            "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()),
        }
    )
    sources = F.broadcast(spark.createDataFrame(table, "source string, source_no long, source_size long, target double").withColumnRenamed("source", "s_source"))
    cells = max(LEAST_CELLS, -(-sum(sizes) // CELL_WORDS))
    rows = rows.withColumn("cell", F.pmod(_seeded(seed, "doc_id", "h1", "h2"), F.lit(cells))).withColumn("order", _seeded(seed + 1, "doc_id", "h1", "h2"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s_source")))

    # A row's place in its source's stream: words of the cells before, and of the rows before within the cell.
    in_cell = Window.partitionBy("source_no", "cell").orderBy("order", "doc_id", "h1", "h2")
    across = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = rows.groupBy("source_no", "cell").agg(F.sum("size").alias("cell_size"))
    by_cell = by_cell.select("source_no", "cell", F.coalesce(F.sum("cell_size").over(across), F.lit(0)).alias("cell_start"))  # a row a cell
    before = F.coalesce(F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("before", before).withColumn("number", F.row_number().over(in_cell)).join(by_cell, ["source_no", "cell"])
    placed = placed.withColumn("start", F.col("cell_start") + F.col("before"))
    placed = materialize(placed.select(*ROW, "doc_id", "h1", "h2", "size", "source_size", "target", "start"), "mix-placed")
    discard(counted)

    covered = F.sequence(F.floor(F.col("start") / planned.block_words), F.floor((F.col("start") + F.col("size") - 1) / planned.block_words))
    spread = placed.filter("size > 0").select(*ROW, "doc_id", "h1", "h2", "size", "start", F.explode(covered).alias("block"))
    draws = spark.createDataFrame(planned.draws, "source_no long, block long, first long, last long, copy long, shard long")
    draws = F.broadcast(draws.withColumnRenamed("first", "b_first").withColumnRenamed("last", "b_last"))  # at most MOST_REPEATS * (BLOCKS + sources) rows of six numbers
    met = spread.join(draws, ["source_no", "block"])
    first = F.greatest(F.col("b_first") - F.col("start"), F.lit(0))
    last = F.least(F.col("b_last") - F.col("start"), F.col("size"))
    pieces = met.select(*ROW, "doc_id", "h1", "h2", "shard", "copy", "block", first.alias("first"), last.alias("last")).filter("first < last")
    return placed, pieces.withColumn("place", _seeded(seed + 2, "shard", "copy", "block", *ROW)), sum(wanted)


def mix(documents: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards of each row of documents; options: see draw.

    shards lists the output shards that the splitting tree gave words of the row to, with their number; taken is the
    sum of these words.
    """
    placed, pieces, _ = draw(documents, **options)
    drawn = pieces.groupBy(*ROW, "shard").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
    taken = drawn.groupBy(*ROW).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))  # a document's own shards
    out = placed.join(taken, ROW, "left")
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed_documents(documents: DataFrame, **options: object) -> DataFrame:
    """The mix as rows of documents: one for each taken copy, or for each taken run of its words (then joined by one space).

    Pieces of a copy that follow each other are put together, whichever shards their blocks fell to, so that only the
    edge of a source's last draw cuts documents. Rows lie by shard and part of it, in shuffled order. Columns pass
    through, whatever their names; see draw for the other cases.
    """
    return mixed_rows(documents, **options).select("gl_row.*")


def mixed_rows(documents: DataFrame, **options: object) -> DataFrame:
    """(gl_row): the rows of mixed_documents as structs."""
    placed, pieces, total = draw(documents, **options)
    parts = -(-total // (PART_WORDS * shards_for(total))) or 1  # a shard is as many tasks, not one
    by_copy = Window.partitionBy(*ROW, "copy").orderBy("first")
    fresh = F.coalesce((F.lag("last").over(by_copy) != F.col("first")).cast("int"), F.lit(1))
    runs = pieces.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_copy))
    runs = runs.groupBy(*ROW, "copy", "run", "doc_id", "h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("shard", "first").alias("shard"), F.min("place").alias("place"))
    runs = runs.select(F.col("doc_id").alias("r_id"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first", "last", "shard", "place")
    h1, h2 = row_identity(documents)
    texts = documents.select(F.struct(*[F.col(quoted(c)) for c in documents.columns]).alias("gl_row"), h1.alias("h1"), h2.alias("h2")).withColumn("id", F.col("gl_row.doc_id"))
    if placed.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        texts = texts.dropDuplicates(["id", "h1", "h2"])  # rows that repeat in every column have pieces of their own, but one of them serves all
    met = texts.join(runs, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    words = words_of(F.col("gl_row.text"))
    whole = (F.col("first") == 0) & (F.col("last") == F.size(words))
    text = F.when(whole, F.col("gl_row.text")).otherwise(F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int")), " "))
    met = met.select(F.col("gl_row").withField("text", text).alias("gl_row"), "shard", F.pmod("place", F.lit(parts)).alias("part"), "place")
    return met.repartition("shard", "part").sortWithinPartitions("shard", "part", "place").select("gl_row")
