"""Tables in the folder all executors share: lineage cuts that survive lost executors, and upsert-style rewrites."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("graphloom_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a private one of this machine, which only a local master can use."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = _own_dir
    return base.rstrip("/")


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors: the files are in storage that every node sees.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._graphloom_path = path
    if _scopes.get():
        _scopes.get()[-1].tables.append(out)
    return out


#: Rows of a few short columns up to which a table goes to all tasks instead of being shuffled with what it meets.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, a cheap table to make twice, with a broadcast hint if it has SMALL_ROWS rows at most; a larger one is joined as any other."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def shuffled(df: DataFrame) -> DataFrame:
    """df, joined by a shuffle of both sides even where it is small enough to be collected and broadcast: a pass joins many times, and what all of these joins collect would pass through the driver."""
    return df.hint("merge")


class Scratch:
    """The tables that cut() makes inside of a with block. free() deletes all but those that were kept; a block may be entered again."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        _scopes.set((*_scopes.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.set(_scopes.get()[:-1])

    def keep(self, *tables: DataFrame) -> None:
        """These tables are the caller's from now on."""
        paths = {getattr(t, "_graphloom_path", None) for t in tables}
        self.tables = [t for t in self.tables if t._graphloom_path not in paths]

    def free(self) -> None:
        discard(*self.tables)
        self.tables = []


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() made and nothing will read again; others are left alone."""
    for t in tables:
        path = getattr(t, "_graphloom_path", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", None):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graphloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/graphloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._graphloom_shipped = True


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch sent to Python workers, always alike, so that whole files and texts go a few MB at a time, and ship the workers' code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
