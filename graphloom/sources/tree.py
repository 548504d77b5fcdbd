"""Source trees as DataFrames: discovery, exclusions, .gitignore, and parsing into tags and aliases."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.manifest import LANGUAGES, excluded_dirs, extension_table
from graphloom.sources.parse import Registry, language_of
from graphloom.sources.store import store_of
from graphloom.storage import bounded_batches, cut

TAG_SCHEMA = "rel_fname string, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, capture_kind string, tag_seq int"
ALIAS_SCHEMA = "rel_fname string, name string, target_name string"


_WILD = re.compile(r"[*?\[]")


def _glob(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def in_excluded_dir(rel_path: Column) -> Column:
    """Whether a folder on the path is excluded: by name, or by pattern where the entry has a wildcard."""
    parts = F.split(rel_path, "/", -1)
    names = [d for d in excluded_dirs() if not _WILD.search(d)]
    globs = [d for d in excluded_dirs() if _WILD.search(d)]
    out = lambda d: d.isin(*names) | (d.rlike("|".join(map(_glob, globs))) if globs else F.lit(False))
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), out)


#: A piece of an ignore pattern: an escaped character, a bracket class, a run of stars, or any other character.
_PIECE = re.compile(r"\\(?P<escaped>.)|\[(?P<not>[!^])?(?P<class>\]?(?:\[:\w+:\]|\\.|[^\]\\])*)\]|(?P<stars>\*+)|(?P<other>.)", re.S)
#: Named classes inside of brackets, as members of a class of Java's and Python's regular expressions.
_NAMED = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": r" \t", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"\x21-\x7e", "lower": "a-z", "print": r"\x20-\x7e", "punct": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e",
    "space": r"\s", "upper": "A-Z", "xdigit": "0-9a-fA-F",
}


def _class(body: str, negated: bool) -> str:
    """A bracket class as a regular expression for one character that is no slash; ranges, escapes and named classes keep their meaning."""
    out = ""
    for named, escaped, other in re.findall(r"\[:(\w+):\]|\\(.)|(.)", body, re.S):
        if named:
            out += _NAMED.get(named, "")
        elif escaped:
            out += re.escape(escaped)
        else:
            out += other if other == "-" else re.escape(other)
    out = re.sub(r"^-|-$", r"\\-", out)
    if not out:
        return "[^/]" if negated else "(?!)"
    out = f"(?!/)[{'^' if negated else ''}{out}]"
    try:
        re.compile(out)
    except re.error:  # a range that ends before it begins matches nothing
        return "(?!)"
    return out


def ignore_pattern(text: str) -> str:
    """The regular expression, over one folder's or file's path, of an ignore pattern without its leading and trailing slash: ? and * stay within a name, ** between slashes spans folders."""
    out, pieces = "", list(_PIECE.finditer(text))
    for i, m in enumerate(pieces):
        before = i == 0 or pieces[i - 1]["other"] == "/"
        after = pieces[i + 1]["other"] if i + 1 < len(pieces) else None
        if m["escaped"] is not None:
            out += re.escape(m["escaped"])
        elif m["class"] is not None:
            out += _class(m["class"], m["not"] is not None)
        elif m["stars"] and len(m["stars"]) == 2 and before and after in ("/", None):
            out += "(?:.*/)?" if after else ".+"
        elif m["stars"]:
            out += "[^/]*"
        elif m["other"] == "/" and i and pieces[i - 1]["stars"] == "**" and (i == 1 or pieces[i - 2]["other"] == "/"):
            pass  # part of the folders that ** spans
        else:
            out += "[^/]" if m["other"] == "?" else re.escape(m["other"])
    return out


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(ignores, pattern over a relative path) for each line of a root .gitignore, in order; the last that matches decides.

    Trailing blanks go unless escaped; # begins a comment and ! a line that keeps, unless escaped. A slash before the
    last character ties a pattern to the root; one at the end asks for a folder.
    """
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep, line = (True, line[1:]) if line.startswith("!") else (False, line)
        folder, body = line.endswith("/"), line.rstrip("/")
        if not body:
            continue
        rooted = "/" in body
        out.append((not keep, ("^" if rooted else "(?:^|.*/)") + ignore_pattern(body.removeprefix("/")) + ("/.*" if folder else "(?:/.*)?") + "$"))
    return out


def ignored(rel_path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for ignores, pattern in rules:
        out = F.when(rel_path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def root_ignore(root: str) -> str:
    """The text of the tree's root .gitignore, empty if there is none."""
    store, base = store_of(root)
    try:
        with store.open_input_file(f"{base}/.gitignore") as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return ""


def tree_paths(spark: SparkSession, root: str, gitignore: str | None = None) -> DataFrame:
    """(rel_fname, length) of all files under root, less what the root .gitignore names. Excluded folders are not entered.

    Spark's own readers leave out names that begin with a dot or an underscore, which source trees have; so folders
    are listed here level by level, each level's in parallel. Links to folders are not followed. gitignore: the text,
    read from the root by default; "" applies none.
    """
    bounded_batches(spark)
    names = [d for d in excluded_dirs() if not _WILD.search(d)]
    globs = re.compile("|".join([_glob(d) for d in excluded_dirs() if _WILD.search(d)] or ["(?!)"]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = store_of(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column("rel_fname").to_pylist():
                rows = []
                try:
                    inside = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    if not folder:
                        raise
                    inside = []  # a folder that cannot be read, or that went meanwhile, holds nothing
                for x in inside:
                    inner = x.type == fs.FileType.Directory
                    if x.type == fs.FileType.NotFound or inner and (x.base_name in names or globs.match(x.base_name) or local and os.path.islink(x.path)):
                        continue
                    rows.append((f"{folder}/{x.base_name}" if folder else x.base_name, x.size or 0, inner))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["rel_fname", "length", "inner"])

    level, found = spark.createDataFrame([("",)], "rel_fname string"), None
    while True:
        here = cut(level.mapInArrow(listed, "rel_fname string, length long, inner boolean"), "tree-level")
        files = here.filter("NOT inner").drop("inner")
        found = files if found is None else found.unionByName(files)
        level = here.filter("inner").select("rel_fname")
        if not level.head(1):
            break
        level = level.repartition(spark.sparkContext.defaultParallelism)
    rules = ignore_rules(root_ignore(root) if gitignore is None else gitignore)
    return found.filter(~ignored(F.col("rel_fname"), rules)) if rules else found


def with_content(paths: DataFrame, root: str) -> DataFrame:
    """paths(rel_fname, ...) with content, read where the rows lie, and error: null, or why the file cannot be read (content is null then)."""
    bounded_batches(paths.sparkSession)
    columns = paths.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            for i, path in enumerate(batch.column("rel_fname").to_pylist()):  # one by one: files may be large
                content = error = None
                try:
                    with store.open_input_file(f"{base}/{path}") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*columns, "content", "error"])

    fields = ", ".join(f"{n} {t}" for n, t in paths.dtypes)
    return paths.repartition(paths.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, f"{fields}, content binary, error string")


def text_of(content: Column) -> Column:
    """The bytes of a file as text, whatever they are: what is not UTF-8 becomes U+FFFD. Offsets of tags are of this text's bytes, where it is what was parsed."""
    return F.make_valid_utf8(content.cast("string"))


def tree_files(spark: SparkSession, root: str, gitignore: str | None = None) -> DataFrame:
    """(rel_fname, length, content, error) of all files under root; see tree_paths and with_content."""
    return with_content(tree_paths(spark, root, gitignore), root)


def with_language(files: DataFrame) -> DataFrame:
    """files(rel_fname, ...) of a supported language, by the extension, with language."""
    ext = F.concat(F.lit("."), F.substring_index("rel_fname", ".", -1))
    known = F.broadcast(extension_table(files.sparkSession).withColumnRenamed("ext", "known_ext"))  # a few rows
    return files.join(known, ext == F.col("known_ext")).drop("known_ext")


def sources(paths: DataFrame, root: str) -> DataFrame:
    """(rel_fname, language, content, error) of those of paths(rel_fname, ...) that are source files; no other file is opened."""
    return with_content(with_language(paths), root).select("rel_fname", "language", "content", "error")


def discover(spark: SparkSession, root: str, gitignore: str | None = None) -> DataFrame:
    """(rel_fname, language, content) of all source files under root that can be read; no other file is opened. See tree_paths."""
    return sources(tree_paths(spark, root, gitignore), root).filter("error IS NULL").drop("error")


def named_paths(spark: SparkSession, root: str, files: list[str], gitignore: str | None = None) -> DataFrame:
    """(rel_fname): those of the given files that a walk of the tree would not leave out by their names; nothing is listed."""
    names = spark.createDataFrame([(f,) for f in dict.fromkeys(files)], "rel_fname string")
    rules = ignore_rules(root_ignore(root) if gitignore is None else gitignore)
    return names.filter(~in_excluded_dir(F.col("rel_fname")) & ~ignored(F.col("rel_fname"), rules))


#: Characters of the texts whose results a task of parsing keeps.
KEPT_CHARS = 4 << 20


def _parsed(files: DataFrame, schema: str, parse: Callable[[Registry, str, str], tuple[list, ...]]) -> DataFrame:
    """The rows that parse(registry, path, text) gives as columns for each of files(rel_fname, content), after the column rel_fname.

    A tree holds many copies of a file (vendored, generated, empty ones): a task parses a text of a language once, and
    forgets what it has parsed where that is more than KEPT_CHARS.
    """
    bounded_batches(files.sparkSession)
    registry = Registry.now()
    fields = [c.split() for c in schema.split(", ")]
    names, kinds = [n for n, _ in fields], [pa.string() if k == "string" else pa.int32() for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, 0
        for batch in batches:
            columns = [[] for _ in names]
            for path, content in zip(batch.column("rel_fname").to_pylist(), batch.column("content").to_pylist(), strict=True):
                language, text = language_of(path, registry.languages), bytes(content or b"").decode("utf-8", "replace")
                key = language and language.name, text
                rows = known.get(key)
                if rows is None:
                    if held > KEPT_CHARS:
                        known, held = {}, 0
                    rows = known[key] = parse(registry, path, text)
                    held += len(text)
                if rows and rows[0]:
                    columns[0].extend([path] * len(rows[0]))
                    for column, values in zip(columns[1:], rows, strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("rel_fname", "content").mapInArrow(run, schema)


def _tag_columns(registry: Registry, path: str, text: str) -> tuple[list, ...]:
    rows = [(t.name, t.kind, t.start_line, t.end_line, t.start_byte, t.end_byte, t.capture_kind, i) for i, t in enumerate(registry.tags(path, text))]
    return tuple(zip(*rows, strict=True))


def _alias_columns(registry: Registry, path: str, text: str) -> tuple[list, ...]:
    return tuple(zip(*registry.aliases(path, text), strict=True))


def parse_tags(files: DataFrame) -> DataFrame:
    """Tags of files(rel_fname, content), parallel across files; tag_seq is the order within a file."""
    return _parsed(files, TAG_SCHEMA, _tag_columns)


def parse_aliases(files: DataFrame) -> DataFrame:
    """Aliases at module level of files(rel_fname, content)."""
    return _parsed(files, ALIAS_SCHEMA, _alias_columns)


def supported_extensions() -> list[str]:
    return [e for x in LANGUAGES for e in x.extensions]


def supported(path: Column) -> Column:
    """Whether a path ends with a supported extension."""
    out = F.lit(False)
    for e in supported_extensions():
        out = out | F.endswith(path, F.lit(e))
    return out


def marked_files(lines: DataFrame) -> DataFrame:
    """(rel_fname): the supported files that the lines (value) of change markers name, each once."""
    path = F.trim("value")
    return lines.filter(supported(path)).select(path.alias("rel_fname")).distinct()


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary column, as tags give them."""
    return F.substring(content, start + 1, end - start)


def allowed_names(tags: DataFrame) -> DataFrame:
    """tags(language, kind, name, ...) without the names that their language excludes as definitions or references."""
    rows = [(x.name, kind, n) for x in LANGUAGES for kind, names in (("def", x.excluded_defs), ("ref", x.excluded_refs)) for n in names]
    out = F.lit(False)
    for language, kind, name in rows:
        out = out | ((F.col("language") == language) & (F.col("kind") == kind) & (F.col("name") == name))
    return tags.filter(~out)


def component_root(name: Column) -> Column:
    """The identifier that a JSX tag's name refers to: the root of a dotted name, a capitalized plain one; null for the page's own tags."""
    return F.when(F.contains(name, F.lit(".")) | name.rlike(r"^\p{Lu}"), F.regexp_extract(name, r"^[^.]+", 0))


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without '.' parts and doubled or leading ones."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")
