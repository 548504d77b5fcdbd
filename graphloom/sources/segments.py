"""A keyed table as a log of Parquet segments under numbered manifests.

A write adds a segment of the rows it changes and then a manifest, the next number, that lists the live segments. A
manifest is created whole and only where none has its number: of two writers one succeeds, and the other one begins
anew on what the first one left. Nothing is ever changed in place, so readers keep what they opened, and a crash
between any two steps leaves the old or the new state. Segments of like size are merged as they gather; what no
manifest names any more goes after a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import delete_path, shuffled

#: Segments of one size class that are merged once there are so many; a class spans a factor of that many rows.
FAN = 8
#: Seconds that replaced segments and manifests are kept for readers that opened them.
RETENTION = 24 * 3600
#: Times that a write begins anew after another writer was faster.
ATTEMPTS = 20


class ConflictError(RuntimeError):
    """Other writers were faster too many times."""


@dataclass(frozen=True)
class Segment:
    """number: the version that wrote it; a row of it is deleted by tombstones of later numbers."""

    number: int
    path: str
    rows: int
    tombstones: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    seq: int = 0  # the greatest that was given out
    added: str = ""  # the path of the segment that this version wrote, "" where it only merged
    segments: list[Segment] = field(default_factory=list)


class SegmentLog:
    """Rows by a key column, with a seq column: of a key's rows that of the greatest seq is live, and only if no later segment deletes the key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, order: str) -> None:
        """order: the column that segments are sorted by, which lets filters on it skip row groups."""
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder.rstrip("/"), schema, key, order

    # -- files

    def _at(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all manifests, ascending."""
        p, fs = self._at(f"{self.folder}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, the last one by default; version 0 is the empty table."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        if not version:
            return Manifest()
        p, fs = self._at(self._path(version))
        stream = fs.open(p)
        try:
            got = json.loads(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode("utf-8"))
        finally:
            stream.close()
        return Manifest(got["version"], got["seq"], got["added"], [Segment(**x) for x in got["segments"]])

    def _path(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def _commit(self, manifest: Manifest) -> bool:
        """Create the manifest, whole, unless one has its number already."""
        fresh, fs = self._at(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(json.dumps(asdict(manifest)).encode())
        out.close()
        target, _ = self._at(self._path(manifest.version))
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":  # a local rename replaces; a link does not
                local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(fresh))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(fresh, False)
        return True

    # -- rows

    def _segment(self, s: Segment) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, deleted boolean").parquet(f"{self.folder}/{s.path}")
        return rows.withColumn("segment", F.lit(s.number))

    def _settled(self, rows: DataFrame, tombstones: bool) -> DataFrame:
        """Of rows(schema, deleted, segment) the live one of each key, and with tombstones those of the last deletion too."""
        of_key = Window.partitionBy(self.key)
        rows = rows.withColumn("gone", F.max(F.when(F.col("deleted"), F.col("segment"))).over(of_key))
        rows = rows.filter((F.col("gone").isNull()) | (F.col("segment") >= F.col("gone")))
        last = Window.partitionBy(self.key, "deleted").orderBy(F.desc("seq"), F.desc("segment"))
        rows = rows.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth", "gone")
        return rows if tombstones else rows.filter("NOT deleted")

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows, of the last version by default; what is read stays so, whatever is written meanwhile.

        The oldest segment, which holds the most, is read as it is but for the keys that later ones touch; only those
        are shuffled.
        """
        names = [c.split()[0] for c in self.schema.split(", ")]
        segments = self.manifest(version).segments
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        base, later = self._segment(segments[0]), [self._segment(s) for s in segments[1:]]
        if not later:
            return base.filter("NOT deleted").select(*names)
        deltas = later[0]
        for x in later[1:]:
            deltas = deltas.unionByName(x)
        touched = deltas.select(self.key).distinct()
        contested = base.join(shuffled(touched), self.key, "left_semi").select(*base.columns).unionByName(deltas)
        free = base.filter("NOT deleted").join(shuffled(touched), self.key, "left_anti")
        return free.select(*names).unionByName(self._settled(contested, False).select(*names))

    def write(self, rows: Callable[[DataFrame, int], tuple[DataFrame, DataFrame | None, int]]) -> Manifest:
        """Add what rows(live rows, last seq) returns: (rows with seq, keys to delete or None, greatest seq); it is asked again where another writer was faster.

        rows hold a key once; a key that is written is not to be deleted at once.
        """
        for _ in range(ATTEMPTS):
            before = self.manifest()
            fresh, gone, seq = rows(self.read(before.version), before.seq)
            number = before.version + 1
            out = fresh.withColumn("deleted", F.lit(False))
            if gone is not None:
                out = out.unionByName(gone.select(self.key).distinct().withColumn("deleted", F.lit(True)), allowMissingColumns=True)
            segment = self._store(out, number)
            if segment is None:
                return before
            manifest = Manifest(number, max(seq, before.seq), segment.path, [*before.segments, segment])
            if self._commit(manifest):
                return self._merge(manifest)
            delete_path(self.spark, f"{self.folder}/{segment.path}")
        raise ConflictError(f"{self.folder}: other writers were faster {ATTEMPTS} times")

    def _store(self, rows: DataFrame, number: int) -> Segment | None:
        """A segment of rows(schema, deleted), or None where there are none."""
        path = f"segments/{number:012d}-{uuid.uuid4().hex}"
        where = f"{self.folder}/{path}"
        names = [*(c.split()[0] for c in self.schema.split(", ")), "deleted"]
        ranged = rows.select(*names).repartitionByRange(self.order, self.key).sortWithinPartitions(self.order, self.key)
        ranged.write.option("compression", "zstd").parquet(where)
        n = self.spark.read.schema(f"{self.schema}, deleted boolean").parquet(where).agg(F.count_if(~F.col("deleted")).alias("rows"), F.count_if("deleted").alias("tombstones")).first()
        if not n.rows + n.tombstones:
            delete_path(self.spark, where)
            return None
        p, fs = self._at(where)
        return Segment(number, path, n.rows, n.tombstones, fs.getContentSummary(p).getLength())

    # -- upkeep

    def _run(self, segments: list[Segment]) -> int | None:
        """Where the segments at the end begin that are to be merged: FAN of one size class or smaller ones."""
        for size in range(1, 40):
            k = len(segments)
            while k and segments[k - 1].rows + segments[k - 1].tombstones < FAN**size:
                k -= 1
            if len(segments) - k >= FAN:
                return k
        return None

    def _merge(self, manifest: Manifest) -> Manifest:
        """Merge the newest segments where FAN of like size have gathered; where another writer is faster, it is left to that one."""
        k = self._run(manifest.segments)
        return manifest if k is None else self._merged(manifest, k) or manifest

    def _merged(self, manifest: Manifest, k: int) -> Manifest | None:
        own = manifest.segments[k:]
        rows = self._segment(own[0])
        for s in own[1:]:
            rows = rows.unionByName(self._segment(s))
        one = self._store(self._settled(rows, tombstones=k > 0), own[-1].number)
        after = Manifest(manifest.version + 1, manifest.seq, "", [*manifest.segments[:k], *([one] if one else [])])
        if self._commit(after):
            return after
        if one:
            delete_path(self.spark, f"{self.folder}/{one.path}")
        return None

    def compact(self) -> Manifest:
        """One segment of the live rows."""
        while len((now := self.manifest()).segments) > 1 or any(s.tombstones for s in now.segments):
            self._merged(now, 0)
        return now

    def vacuum(self, retention: float = RETENTION) -> int:
        """Delete manifests, but the last, and segments that no manifest names, both of an age of retention seconds or more; returns how many segments went."""
        oldest, known = (time.time() - retention) * 1000, self.versions()
        p, fs = self._at(f"{self.folder}/manifests")
        if not known:
            return 0
        age = {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(p)}
        kept = [v for v in known[:-1] if age.get(f"{v:012d}.json", oldest + 1) > oldest] + known[-1:]
        named = {s.path for v in kept for s in self.manifest(v).segments}
        gone, (where, _) = 0, self._at(f"{self.folder}/segments")
        for v in set(known) - set(kept):
            delete_path(self.spark, self._path(v))
        for x in fs.listStatus(where) if fs.exists(where) else []:
            if f"segments/{x.getPath().getName()}" not in named and x.getModificationTime() <= oldest:
                delete_path(self.spark, x.getPath().toString())
                gone += 1
        return gone
