"""Changed files between two states of a tree, by digests of its folders: equal folders are never opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut

#: Nodes: depth 0 is the root (path ""). digest: of a file's content, or of all that a folder holds.
NODES = "path string, parent string, folder boolean, digest string, files long, depth int"


def _prefixes(path: Column) -> Column:
    """All folders above a path, the root (empty) first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth")))


def parent_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def digests(files: DataFrame) -> DataFrame:
    """(NODES) of files(rel_fname, digest): each file, and each folder with a digest of the names and digests of all files below.

    A folder's digest adds up 128-bit hashes of its files in any order, so that folders of any number of files fold
    before the shuffle. Repeated rows of a file are one; a null digest is one of its own.
    """
    own = files.groupBy(F.col("rel_fname").alias("path")).agg(F.coalesce(F.min("digest"), F.lit("")).alias("digest"))
    h = [F.xxhash64(F.lit(seed), "path", "digest") for seed in (1, 2)]
    up = own.select(F.explode(_prefixes(F.col("path"))).alias("up"), h[0].alias("a"), h[1].alias("b"))
    wide = "decimal(38,0)"
    folders = up.groupBy("up.path", "up.depth").agg(F.concat_ws("-", F.hex(F.bit_xor("a")), F.hex(F.bit_xor("b")), F.sum(F.col("a").cast(wide)).cast("string"), F.count("*").cast("string")).alias("digest"), F.count("*").alias("files"))
    leaves = own.select("path", parent_of(F.col("path")).alias("parent"), F.lit(False).alias("folder"), "digest", F.lit(1).cast("long").alias("files"), F.size(F.split("path", "/", -1)).alias("depth"))
    parent = F.when(F.col("depth") > 0, parent_of(F.col("path")))
    return leaves.unionByName(folders.select("path", parent.alias("parent"), F.lit(True).alias("folder"), "digest", "files", "depth"))


class TreeState:
    """The digests of one state of a tree in a folder, by depth: a comparison reads a level, and of it the children of folders that differ."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, files: DataFrame) -> TreeState:
        digests(files).repartition("depth", "parent").sortWithinPartitions("depth", "parent", "path").write.partitionBy("depth").option("compression", "zstd").parquet(self.folder)
        return self

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema(NODES).parquet(self.folder).filter(F.col("depth") == depth)


def changed_files(old: TreeState, new: TreeState) -> tuple[DataFrame, DataFrame]:
    """(changes, opened): (rel_fname, change) of the files that were added, removed or changed, and (path, depth) of the folders whose children were compared.

    Levels are compared from the root down; of each level only the children of folders whose digests differ. A file
    that became a folder, or the reverse, is removed and its others are added.
    """
    spark = old.spark
    open_ = spark.createDataFrame([("",)], "parent string")
    changes, opened, depth, levels = None, None, 1, []
    if not _differ(old.level(0), new.level(0)).head(1):
        return spark.createDataFrame([], "rel_fname string, change string"), spark.createDataFrame([], "path string, depth int")
    while True:
        here = cut(_differ(old.level(depth).join(open_, "parent", "left_semi"), new.level(depth).join(open_, "parent", "left_semi")), "tree-level")
        levels.append(here)
        change = F.when(F.col("o_digest").isNull(), "added").when(F.col("n_digest").isNull(), "removed").otherwise("changed")
        own = here.filter("NOT folder").select(F.col("path").alias("rel_fname"), change.alias("change"))
        looked = open_.select(F.col("parent").alias("path"), F.lit(depth - 1).alias("depth"))
        changes, opened = own if changes is None else changes.unionByName(own), looked if opened is None else opened.unionByName(looked)
        open_ = here.filter("folder").select(F.col("path").alias("parent"))
        if not open_.head(1):
            return cut(changes, "tree-changes"), opened
        depth += 1


def _differ(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, folder, o_digest, n_digest) of the nodes whose digests differ, or that one side lacks."""
    side = lambda d, name: d.select("path", "folder", F.col("digest").alias(name))
    both = side(old, "o_digest").join(side(new, "n_digest"), ["path", "folder"], "full")
    return both.filter(~F.col("o_digest").eqNullSafe(F.col("n_digest")))
