"""A source tree as a Python data source: filters on path and size reach the scan, so that a file or a folder reads itself alone."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from graphloom.sources.manifest import excluded_dirs
from graphloom.sources.store import store_of
from graphloom.sources.tree import _WILD, _glob, ignore_rules, root_ignore
from graphloom.storage import ship

FORMAT = "graphloom_tree"
SCHEMA = "rel_fname string, length long, content binary, error string"
_ARROW = pa.schema([("rel_fname", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Folders that the plan lists before the rest of each is left to a task.
PLANNED_FOLDERS = 64


class Walk:
    """What a walk of the tree enters and takes, by names alone."""

    def __init__(self, gitignore: str) -> None:
        self.names = {d for d in excluded_dirs() if not _WILD.search(d)}
        self.globs = re.compile("|".join([_glob(d) for d in excluded_dirs() if _WILD.search(d)] or ["(?!)"]))
        self.rules = [(ignores, re.compile(pattern)) for ignores, pattern in ignore_rules(gitignore)]

    def enters(self, folder: str) -> bool:
        return all(x not in self.names and not self.globs.match(x) for x in folder.split("/") if x)

    def takes(self, path: str) -> bool:
        out = False
        for ignores, pattern in self.rules:
            out = ignores if pattern.search(path) else out
        return not out


class Part(InputPartition):
    """Files by name, or all below a folder."""

    def __init__(self, files: list[str] | None, folder: str | None) -> None:
        self.files, self.folder = files, folder


class Reader(DataSourceReader):
    def __init__(self, root: str, gitignore: str, content: bool) -> None:
        self.root, self.walk, self.content = root, Walk(gitignore), content
        self.exact: set[str] | None = None
        self.prefix = ""
        self.sizes: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equality, lists and prefixes of rel_fname and bounds of length; yields the others, which Spark applies."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column == "rel_fname" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else {v for v in f.value if v is not None}
                self.exact = own if self.exact is None else self.exact & own
            elif column == "rel_fname" and isinstance(f, StringStartsWith) and (self.prefix.startswith(f.value) or f.value.startswith(self.prefix)):
                self.prefix = max(self.prefix, f.value, key=len)
            elif column == "length" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.sizes.append(f)
            else:
                yield f

    def _fits(self, path: str, length: int) -> bool:
        ok = {GreaterThan: lambda v: length > v, GreaterThanOrEqual: lambda v: length >= v, LessThan: lambda v: length < v, LessThanOrEqual: lambda v: length <= v}
        return path.startswith(self.prefix) and (self.exact is None or path in self.exact) and self.walk.takes(path) and all(ok[type(f)](f.value) for f in self.sizes)

    def _listed(self, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """(files with sizes, folders to enter) right in a folder; one that cannot be read holds nothing."""
        from pyarrow import fs

        store, base = store_of(self.root)
        local = isinstance(store, fs.LocalFileSystem)
        try:
            inside = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
        except OSError:
            return [], []
        files, folders = [], []
        for x in inside:
            path = f"{folder}/{x.base_name}" if folder else x.base_name
            if x.type == fs.FileType.File and self._fits(path, x.size or 0):
                files.append((path, x.size or 0))
            elif x.type == fs.FileType.Directory and self.walk.enters(x.base_name) and not (local and os.path.islink(x.path)) and (f"{path}/".startswith(self.prefix) or self.prefix.startswith(f"{path}/")):
                folders.append(path)
        return files, folders

    def partitions(self) -> list[InputPartition]:
        if self.exact is not None:  # nothing is listed
            own = sorted(p for p in self.exact if p and not p.startswith("/") and ".." not in p.split("/") and self.walk.enters(p.rpartition("/")[0]))
            return [Part(own[i : i + 64], None) for i in range(0, len(own), 64)] or [Part([], None)]
        found: list[str] = []
        level = [""]
        while level and len(level) < PLANNED_FOLDERS:
            below: list[str] = []
            for folder in level:
                files, folders = self._listed(folder)
                found += [p for p, _ in files]
                below += folders
            level = below
        parts = [Part(found[i : i + 64], None) for i in range(0, len(found), 64)] + [Part(None, f) for f in level]
        return parts or [Part([], None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(self.root)
        stack, named = ([partition.folder] if partition.folder is not None else []), partition.files or []
        infos = store.get_file_info([f"{base}/{p}" for p in named]) if named else []
        files = [(p, x.size or 0) for p, x in zip(named, infos, strict=True) if x.type == fs.FileType.File and self._fits(p, x.size or 0)]
        while files or stack:
            if not files:
                files, folders = self._listed(stack.pop())
                stack += folders
                continue
            path, length = files.pop()
            content = error = None
            if self.content:
                try:
                    content = self._open(store, f"{base}/{path}")
                except OSError as e:
                    error = str(e) or type(e).__name__
            yield pa.RecordBatch.from_pylist([{"rel_fname": path, "length": length, "content": content, "error": error}], schema=_ARROW)

    def _open(self, store: object, path: str) -> bytes:
        with store.open_input_file(path) as f:
            return f.read()


class SourceTree(DataSource):
    """Options: path, the root; gitignore, the text of ignore rules (the root's .gitignore by default); content: false for names and sizes alone."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        root = self.options["path"]
        return Reader(root, self.options["gitignore"] if "gitignore" in self.options else root_ignore(root), self.options.get("content", "true").lower() == "true")


def scan_tree(spark: SparkSession, root: str, gitignore: str | None = None, content: bool = True) -> DataFrame:
    """(rel_fname, length, content, error) of the files that a walk of root takes, as tree.tree_files() has them.

    A filter on rel_fname (equality, a list, a prefix) or length reaches the scan: named files are opened without any
    listing, a prefix lists its folders alone, and files of other sizes are not opened. Folders beyond the first
    PLANNED_FOLDERS are listed by the tasks.
    """
    ship(spark)
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("path", root.rstrip("/")).option("content", str(content).lower())
    return (reader if gitignore is None else reader.option("gitignore", gitignore)).load()
