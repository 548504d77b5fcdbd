"""Importance resampling towards a target distribution over hashed n-gram buckets.

DuckDB runs in each task: SQL unnests the words, windows them into n-grams and hashes each distinct one by a registered
zlib CRC function. A text's counts by bucket are written as Parquet; Spark merges them to the corpus' and the target's
totals, scores each text by the gains of its buckets, and draws the highest scores with a Gumbel term.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, small, small_batches
from graphloom.llm.textops import utf8

#: Least and greatest number of words in a feature, buckets that features are hashed to, and the base of whole-number gains.
LEAST_N, MOST_N, BUCKETS, UNIT = 1, 1, 10_000, 1000
#: Share of the texts of LEAST_WORDS words or more that is drawn, in per cent, and the seed of the draw.
PER_CENT, LEAST_WORDS, SEED = 10, 20, 2024
#: Bytes of a text as words are read: A-Z lower-cased; ASCII other than letters and digits separates; bytes from 0x80 belong to words.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
SPILLED = "row_no long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
_ARROW = pa.schema(
    [("row_no", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
)


def features_sql(least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS) -> str:
    """DuckDB SQL from texts(row, text), folded, to a row for each text: row, n_words, n_features, buckets, counts."""
    runs = []
    for n in range(least, most + 1):
        run = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER one" for k in range(1, n))])
        runs.append(f"SELECT row, {run} AS feature FROM words" + (" WINDOW one AS (PARTITION BY row ORDER BY pos)" if n > 1 else ""))
    return f"""
WITH split AS (SELECT row, list_filter(string_split(text, ' '), lambda x: x <> '') AS list FROM texts),
words AS (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM split),
seen AS (SELECT row, feature, count(*) AS n FROM ({" UNION ALL ".join(runs)}) WHERE feature IS NOT NULL GROUP BY ALL),
hashed AS (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM seen)),
counted AS (SELECT row, bucket, sum(n) AS n FROM seen JOIN hashed USING (feature) GROUP BY ALL),
listed AS (SELECT row, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::INTEGER ORDER BY bucket) AS counts FROM counted GROUP BY row)
SELECT row, len(list)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::INTEGER[]) AS counts
FROM split LEFT JOIN listed USING (row) ORDER BY row"""


def _crc32(words: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def _folded(column: pa.Array) -> pa.Array:
    """The texts, nulls empty, with FOLDED bytes; the byte view is exact, since ASCII bytes are never part of other characters."""
    raw, offsets = utf8(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.array(offsets, pa.int64()).buffers()[1], pa.py_buffer(raw.tobytes().translate(FOLDED))])


def bucket_counts(texts: DataFrame, least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS) -> DataFrame:
    """(SPILLED) of each row of texts(doc_id, text), written to the shared folder: the buckets of its features, ascending, with their counts.

    row_no is a number of the row's own. Each task reads a few MB of texts at a time into a DuckDB of its own; nothing
    is shuffled. See resample for the defined cases.
    """
    small_batches(texts.sparkSession)
    sql = features_sql(least, most, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            db.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                n = batch.num_rows
                db.register("texts", pa.table({"row": pa.array(range(n), pa.int64()), "text": _folded(batch.column("text"))}))
                got = db.sql(sql).to_arrow_table()
                db.unregister("texts")
                columns = [pa.array(range(number, number + n), pa.int64()), batch.column("doc_id"), *(got.column(c).combine_chunks() for c in ("n_words", "n_features", "buckets", "counts"))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
                number += n

    return materialize(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPILLED), "bucket-counts", "zstd")


def totals(counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all rows by bucket; a number a bucket reaches the driver."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    out = [0] * buckets
    for bucket, n in each.collect():  # at most a row a bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: list[int], target: list[int], unit: int = UNIT) -> list[int]:
    """floor(unit * ln of the target's share of a bucket by the corpus' share), each with one feature added to every bucket."""
    s, t, k = sum(corpus), sum(target), len(corpus)
    return [math.floor(unit * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(corpus, target, strict=True)]


def weighed(counts: DataFrame, gains: list[int], unit: int = UNIT, seed: int = SEED) -> DataFrame:
    """counts with weight, the sum of a row's gains, and score, the weight with a Gumbel term of the doc_id's SHA-256."""
    known = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # a constant of a number a bucket
    parts = F.zip_with("buckets", "counts", lambda b, n: F.get(known, b) * n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-unit * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = counts.withColumn("weight", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.withColumn("score", F.col("weight") + gumbel).drop("buckets", "counts")


def highest(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """rows with rank (long): 1 to k in the given total order, else null.

    The rows are sorted in ranges, which are counted; only the ranges that hold the first k are numbered, each on its
    own. No task holds all rows.
    """
    ranged = materialize(rows.orderBy(*order).withColumn("gl_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("gl_range").agg(F.count("*").alias("gl_n"))  # a row a partition
    before = sizes.withColumn("gl_before", F.sum("gl_n").over(Window.orderBy("gl_range")) - F.col("gl_n")).select("gl_range", "gl_before")
    placed = ranged.join(small(before), "gl_range")
    own = F.row_number().over(Window.partitionBy("gl_range").orderBy(*order)).cast("long")
    first = placed.filter(F.col("gl_before") < k).withColumn("rank", F.col("gl_before") + own)
    first = first.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = placed.filter(F.col("gl_before") >= k).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("gl_range", "gl_before")


def resample(documents: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: tuple[int, int] = (LEAST_N, MOST_N), buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row of documents(doc_id, text), drawn towards target(text).

    n: least and greatest number of words in a feature. Of the texts of least_words words or more, floor(per_cent % of
    them) are drawn: those of the highest scores, ties to the smaller doc_id, null ids last. Defined cases: a null,
    empty or wordless text has no features and weight 0; a null doc_id scores as an empty id; rows that repeat are
    counted and drawn each on its own (equal ids with equal scores in the order of n_words, then of reading); texts of
    any length are read whole; other columns are ignored, whatever their names; an empty target has equal shares in
    all buckets; an empty table gives no rows.
    """
    counts = bucket_counts(documents, *n, buckets)
    aims = bucket_counts(target.select(F.lit(None).alias("doc_id"), "text"), *n, buckets)
    gains = bucket_gains(totals(counts, buckets), totals(aims, buckets))
    scored = materialize(weighed(counts, gains, seed=seed), "scored")
    discard(counts, aims)
    eligible = F.col("n_words") >= least_words
    k = per_cent * scored.filter(eligible).count() // 100
    drawn = highest(scored.filter(eligible), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("row_no"))
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(documents: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """(doc_id, rank) of the drawn rows alone; see resample."""
    return resample(documents, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")


#: DuckDB has no CRC32: the table of its 256 entries is made by the polynomial's rule, then applied to each byte of each distinct word.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b::BIGINT AS b, b::BIGINT AS c, 0 AS k FROM range(256) AS t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), lookup AS (
  SELECT list(c ORDER BY b) AS entries FROM steps WHERE k = 8
), words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM documents
  UNION ALL SELECT 'b', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), seen AS (
  SELECT kind, row, word, count(*) AS n FROM (SELECT kind, row, unnest(list) AS word FROM words) GROUP BY ALL
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, entries[(xor(c, b) % 256) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM seen), lookup
), counted AS (
  SELECT kind, row, bucket, sum(n)::BIGINT AS n FROM seen JOIN hashed USING (word) GROUP BY ALL
), sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::BIGINT AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sides) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM sides) + 10000))::DOUBLE))::BIGINT AS gain FROM sides
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row
), scored AS (
  SELECT w.row, w.doc_id, len(w.list)::BIGINT AS n_words, coalesce(x.n_features, 0)::BIGINT AS n_features, coalesce(x.weight, 0)::BIGINT AS weight,
    coalesce(x.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words AS w LEFT JOIN weights AS x ON w.row = x.row WHERE w.kind = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_words, row) AS r, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= eligible * 10 // 100 THEN r END AS rank FROM ranked
"""
