"""Tables that outlive a job: the result cache, a log of Parquet segments, and the vector table, in partitioned folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cache as C
from graphloom.sources.segments import RETENTION, SegmentLog
from graphloom.storage import cut, delete_path, discard

CACHE_SCHEMA = (
    "cache_key string, fn_id string, explanation_json string, fn_hash string, context_hash string, model_id string, embedding_model_id string, prompt_version string, "
    "context_tier string, generated_at string, seq long"
)
VECTOR_SCHEMA = "rel_fname string, start_line int, end_line int, text string, vector array<float>"
#: Folders that a vector table's files are dealt to by name, so that a changed file rewrites one of them.
BUCKETS = 64


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class CacheTable:
    """The result cache in a folder: a log of the rows that each write changed (see SegmentLog), so a write costs what it writes, and readers keep what they opened."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Opens the cache; a folder without one is an empty cache, and nothing is created before the first write."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = SegmentLog(spark, folder, CACHE_SCHEMA, "cache_key", "fn_id")
        self.listeners: list[Callable[[DataFrame], None]] = []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows, of the last version by default; a later write does not change what is read."""
        return self.log.read(version)

    def version(self) -> int:
        return self.log.manifest().version

    def on_write(self, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Call listener with the written rows after each write of this object; returns a function that ends this. Other sessions: see changes.cache_changes."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def write(self, rows: DataFrame, evict: bool = True) -> None:
        """Upsert rows (CACHE_SCHEMA without seq, or with it); evict: what they supersede goes. Then the listeners are told.

        Of rows with one key, that of the greatest seq is written. Where another writer is faster, seqs and evictions
        are made anew on what it left.
        """
        names = [c.split()[0] for c in CACHE_SCHEMA.split(", ")]
        given = "seq" in rows.columns
        kept = cut(rows.select(*(n for n in names if given or n != "seq")), "cache-write")
        written: list[DataFrame] = []

        def change(live: DataFrame, last: int) -> tuple[DataFrame, DataFrame | None, int]:
            discard(*written)
            told = cut((kept if given else C.numbered(kept, last, ["generated_at", "cache_key"])).select(*names), "cache-batch")
            fresh = C.newest(told)
            written[:] = [told]
            return fresh, C.evicted(live, fresh) if evict else None, told.agg(F.max("seq")).first()[0] or last

        self.log.write(change)
        for listener in list(self.listeners):
            listener(written[0])
        discard(kept)
        if not self.listeners:
            discard(*written)

    def purge(self) -> int:
        """Delete superseded rows; returns how many. Only their keys are written."""
        gone = 0

        def change(live: DataFrame, last: int) -> tuple[DataFrame, DataFrame, int]:
            nonlocal gone
            keys = cut(live.join(C.current_rows(live).select("cache_key"), "cache_key", "left_anti").select("cache_key"), "purged")
            gone = keys.count()
            return live.limit(0), keys, last

        self.log.write(change)
        return gone

    def compact(self, retention: float = RETENTION) -> None:
        """Merge all segments into one, and delete what no reader of the last `retention` seconds can have opened."""
        self.log.compact()
        self.log.vacuum(retention)


class VectorTable:
    """Chunks and their vectors in a folder, partitioned by a hash of the file's name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/vectors"

    def exists(self) -> bool:
        p, fs = _path(self.spark, self.folder)
        return bool(fs.exists(p))

    def read(self) -> DataFrame:
        """VECTOR_SCHEMA; no rows where there is no table."""
        if not self.exists():
            return self.spark.createDataFrame([], VECTOR_SCHEMA)
        return self.spark.read.schema(f"{VECTOR_SCHEMA}, bucket int").parquet(self.folder).drop("bucket")

    def file(self, rel_fname: str) -> DataFrame:
        """One file's rows, from its folder alone."""
        if not self.exists():
            return self.read()
        both = self.spark.read.schema(f"{VECTOR_SCHEMA}, bucket int").parquet(self.folder)
        return both.filter((F.col("bucket") == self._bucket(rel_fname)) & (F.col("rel_fname") == rel_fname)).drop("bucket")

    def _bucket(self, rel_fname: str) -> int:
        return self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(rel_fname)), F.lit(BUCKETS))).first()[0]

    def _write(self, rows: DataFrame) -> None:
        rows = rows.select("rel_fname", "start_line", "end_line", "text", "vector", F.pmod(F.xxhash64("rel_fname"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "rel_fname", "start_line")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.folder)

    def replace_all(self, rows: DataFrame) -> int:
        """All rows replaced; without any, the table goes. Returns how many there are."""
        rows = cut(rows, "vectors-all")
        n = rows.count()
        delete_path(self.spark, self.folder)
        if n:
            self._write(C.replace_all(self.read(), rows))
        discard(rows)
        return n

    def replace_file(self, rel_fname: str, rows: DataFrame) -> int:
        """One file's rows replaced, in its folder alone; without any, they go."""
        bucket = self._bucket(rel_fname)
        old = self.spark.read.schema(f"{VECTOR_SCHEMA}, bucket int").parquet(self.folder).filter(F.col("bucket") == bucket).drop("bucket") if self.exists() else self.read()
        fresh = cut(C.replace_file(old, rows, rel_fname), "vectors-file")
        n = fresh.filter(F.col("rel_fname") == rel_fname).count()
        if fresh.head(1):
            self._write(fresh)
        else:
            delete_path(self.spark, f"{self.folder}/bucket={bucket}")
        discard(fresh)
        return n
