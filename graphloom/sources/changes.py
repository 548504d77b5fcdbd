"""The writes of a result cache as a stream, for other sessions: a Python data source over the manifests of its log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from graphloom.sources.store import store_of
from graphloom.sources.tables import CACHE_SCHEMA
from graphloom.storage import ship

FORMAT = "graphloom_cache_changes"
SCHEMA = f"{CACHE_SCHEMA}, deleted boolean, version long"


class CacheChanges(DataSource):
    """Options: path, the cache's folder; fromVersion, the last version that is not read (0: all)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return ChangeReader(self.options["path"], int(self.options.get("fromVersion", "0")))


class Part(InputPartition):
    def __init__(self, path: str, version: int) -> None:
        self.path, self.version = path, version


class ChangeReader(DataSourceStreamReader):
    """Offsets are versions; a partition is a file of the segment that a version added. Versions that only merged add none."""

    def __init__(self, folder: str, first: int) -> None:
        self.folder, self.first = folder, first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, base = store_of(self.folder)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))]
        return {"version": max([self.first, *(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        store, base = store_of(self.folder)
        out: list[InputPartition] = []
        for version in range(start["version"] + 1, end["version"] + 1):
            try:
                with store.open_input_file(f"{base}/manifests/{version:012d}.json") as f:
                    added = json.loads(f.read())["added"]
                files = store.get_file_info(fs.FileSelector(f"{base}/{added}")) if added else []
            except FileNotFoundError as e:
                raise ValueError(f"version {version} of {self.folder} is gone: this stream fell behind the retention time") from e
            out += [Part(x.path, version) for x in files if x.base_name.endswith(".parquet")]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, _ = store_of(self.folder)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(512):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.version] * batch.num_rows, pa.int64())], names=[*batch.schema.names, "version"])


def cache_changes(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """A stream of the rows (CACHE_SCHEMA) that each write after a version put into the cache, and of the keys it deleted (deleted), with the version of the write.

    With a checkpoint a restarted query goes on where it ended. A query that is further behind than the retention time
    of the cache fails, since it could not see every write.
    """
    ship(spark)
    spark.dataSource.register(CacheChanges)
    return spark.readStream.format(FORMAT).option("path", folder.rstrip("/")).option("fromVersion", str(after)).load()
