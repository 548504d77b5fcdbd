"""Codebase digest and summary pages: walk order, budgets, tree, skipped files, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FILES, MAX_BYTES, MAX_CHARS = 5000, 100_000, 2_000_000


def walk_key(path: Column) -> Column:
    """Sorts as a top-down walk: a folder's files by name, then its folders by name."""
    parts = F.split(path, "/", -1)
    return F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).alias("deep"), x.alias("name")))


def walk(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The first `most` files in walk order, with place (from 0): a bounded list."""
    first = files.withColumn("walk", walk_key(F.col("rel_path"))).orderBy("walk").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("walk")) - 1).drop("walk")


def with_budget(files: DataFrame, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS) -> DataFrame:
    """files(rel_path, place, size_bytes, chars, binary, and unreadable if there is such a column) with skip_reason (null: included) and cum.

    The running sum counts eligible files' characters in walk order, so once it is beyond the budget it stays there.
    files is walk()'s bounded list, so one ordered window suits it.
    """
    unreadable = F.col("unreadable") if "unreadable" in files.columns else F.lit(False)
    eligible = (F.col("size_bytes") <= max_bytes) & ~F.col("binary") & ~unreadable
    cum = F.sum(F.when(eligible, F.col("chars")).otherwise(0)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(F.col("cum") > max_chars, "budget-exceeded").when(F.col("size_bytes") > max_bytes, "too-large").when(F.col("binary"), "binary").when(unreadable, "unreadable")
    return files.withColumn("cum", cum).withColumn("skip_reason", reason)


def digest_summary(files: DataFrame, max_files: int = MAX_FILES, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row: total_files, included_files, skipped_files, truncated."""
    return files.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("skip_reason").isNull()).alias("included_files"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_files"),
        ((F.count("*") >= max_files) | F.coalesce(F.bool_or(F.col("cum") > max_chars), F.lit(False))).alias("truncated"),
    )


def tree(paths: DataFrame) -> DataFrame:
    """(place key, line): the tree of paths(rel_path), each level by lower-cased name; key sorts the lines."""
    parts = F.split("rel_path", "/", -1)
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.slice(parts, 1, i).alias("path"), (i < F.size(parts)).alias("dir")))).alias("n"))
    nodes = prefixes.groupBy("n.path").agg(F.bool_or("n.dir").alias("dir"))
    parent = F.array_join(F.slice("path", 1, F.size("path") - 1), "/")
    order = F.struct(F.lower(F.element_at("path", -1)), F.element_at("path", -1))
    own = Window.partitionBy("parent").orderBy(order)
    nodes = nodes.withColumn("parent", parent).withColumn("last", F.lead("path").over(own).isNull())
    # A node's line needs to know, for each folder above it, whether that one is the last of its own level.
    above = nodes.select(F.array_join("path", "/").alias("a_path"), F.col("last").alias("a_last"))
    folders = F.expr("CASE WHEN size(path) > 1 THEN transform(sequence(1, size(path) - 1), i -> array_join(slice(path, 1, i), '/')) END")
    ups = nodes.withColumn("up", F.explode_outer(folders))
    bars = ups.join(above, F.col("up") == F.col("a_path"), "left").groupBy("path", "dir", "last").agg(F.sort_array(F.collect_list(F.struct(F.length("up").alias("depth"), "a_last"))).alias("bars"))
    indent = F.array_join(F.transform(F.filter("bars", lambda b: b["a_last"].isNotNull()), lambda b: F.when(b["a_last"], "    ").otherwise("│   ")), "")
    line = F.concat(indent, F.when(F.col("last"), "└── ").otherwise("├── "), F.element_at("path", -1), F.when(F.col("dir"), "/").otherwise(""))
    return bars.select(F.transform("path", lambda x: F.struct(F.lower(x), x)).alias("key"), F.array_join("path", "/").alias("path"), line.alias("line"))


def render(name: str, summary: DataFrame, tree_lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row, text: the digest of walk()'s bounded list, files with rel_path, place, size_bytes, skip_reason and content."""
    lines = tree_lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n").alias("tree"))
    skipped = files.filter("skip_reason IS NOT NULL").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("  - "), "rel_path", F.lit(" ("), "skip_reason", F.lit(", "), F.col("size_bytes").cast("string"), F.lit(" bytes)")).alias("l")))), lambda x: x["l"]), "\n").alias("skipped"))
    bar = "=" * 48
    body = files.filter("skip_reason IS NULL").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit(f"{bar}\nFile: "), "rel_path", F.lit(f"\n{bar}\n"), "content", F.lit("\n")).alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    one = summary.join(lines).join(skipped).join(body)  # one row each
    head = F.concat(F.lit(f"Codebase digest: {name}\n\n"), F.col("included_files").cast("string"), F.lit(" of "), F.col("total_files").cast("string"), F.lit(" file(s) included"), F.when(F.col("skipped_files") > 0, F.concat(F.lit(", "), F.col("skipped_files").cast("string"), F.lit(" skipped"))).otherwise(""), F.lit("."))
    note = F.when(F.col("truncated"), "\nNOTE: truncated by a size or count budget.").otherwise("")
    parts = [head, note, F.lit(f"\n\nDirectory structure:\n{name}/\n"), F.col("tree"), F.lit("\n"), F.when(F.col("skipped") != "", F.concat(F.lit("\nSkipped files:\n"), "skipped", F.lit("\n"))).otherwise(""), F.lit("\n"), F.col("body")]
    return one.select(F.concat(*parts).alias("text"))


KEY_FUNCTIONS = 25
#: Headings, links and table heads of the pages.
SUMMARY, FUNCTIONS_HEAD, FILES_HEAD, SEE_ALSO = "Codebase Summary", "## Functions\n\n", "## Files\n\n", "\n\n## See also\n\n- [Key Functions Index](functions.md)"
KEY_HEAD, KEY_TABLE = "# Key Functions\n\n", "| Function | File | Role | Summary |\n|---|---|---|---|\n"


def functions_by_file(ranked: DataFrame, entry: Column) -> DataFrame:
    """(rel_fname, functions): each file's entries, an array in the order of ranked(rel_fname, pos, ...)."""
    return ranked.groupBy("rel_fname").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]).alias("functions"))


def file_page(functions: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """(rel_fname, page): a Markdown page a file of functions(rel_fname, name, line, role_tag, one_liner, pos), with its purpose if given by purposes(rel_fname, purpose)."""
    part = F.concat(F.lit("### "), "name", F.lit(" ("), F.coalesce("role_tag", F.lit("Unclassified")), F.lit(")\n\n"), F.coalesce("one_liner", F.lit("_(no summary cached)_")), F.lit("\n\nLine "), (F.col("line") + 1).cast("string"), F.lit(".\n"))
    pages = functions_by_file(functions, part).select("rel_fname", F.array_join("functions", "\n").alias("b"))
    pages = pages.withColumn("purpose", F.lit(None).cast("string")) if purposes is None else pages.join(purposes, "rel_fname", "left")
    head = F.when(F.col("purpose").isNotNull(), F.concat("purpose", F.lit("\n\n"))).otherwise("")
    return pages.select("rel_fname", F.concat(F.lit("# "), "rel_fname", F.lit("\n\n"), head, F.lit(FUNCTIONS_HEAD), "b").alias("page"))


def index_page(functions: DataFrame, purposes: DataFrame, name: str) -> DataFrame:
    """One row, page: the list of files, in the order of their first function's pos, with the first sentence of each purpose."""
    from graphloom.functions.text import first_sentence

    files = functions.groupBy("rel_fname").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).join(purposes, "rel_fname", "left")
    line = F.concat(F.lit("- ["), "rel_fname", F.lit("]("), "rel_fname", F.lit(".md) — "), first_sentence(F.coalesce("purpose", F.lit(""))))
    one = files.agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.sort_array(F.collect_list(F.struct("pos", "rel_fname", line.alias("l")))).alias("lines"))
    head = F.concat(F.lit(f"# {name} — {SUMMARY}\n\nFrom "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" explained function(s) across "), F.col("files").cast("string"), F.lit(f" file(s).\n\n{FILES_HEAD}"))
    return one.select(F.concat(head, F.array_join(F.transform("lines", lambda x: x["l"]), "\n"), F.lit(SEE_ALSO)).alias("page"))


def functions_page(functions: DataFrame, most: int = KEY_FUNCTIONS) -> DataFrame:
    """One row, page: a table of the first `most` functions by pos."""
    from graphloom.functions.text import table_cell

    place = F.concat(F.lit("["), "rel_fname", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit("]("), "rel_fname", F.lit(".md)"))
    line = F.concat(F.lit("| "), "name", F.lit(" | "), place, F.lit(" | "), F.coalesce("role_tag", F.lit("Unclassified")), F.lit(" | "), table_cell(F.coalesce("one_liner", F.lit(""))), F.lit(" |"))
    top = functions.orderBy("pos", "rel_fname", "name", "line").limit(most)
    one = top.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "rel_fname", "name", line.alias("l")))).alias("lines"))
    head = F.concat(F.lit(f"{KEY_HEAD}The "), F.col("n").cast("string"), F.lit(f" most important function(s), by the call graph.\n\n{KEY_TABLE}"))
    return one.select(F.concat(head, F.array_join(F.transform("lines", lambda x: x["l"]), "\n")).alias("page"))


def pages(explained: DataFrame, purposes: DataFrame, name: str) -> DataFrame:
    """(path, page) of all pages of explained(rel_fname, name, line, role_tag, one_liner, importance)."""
    from graphloom.operators.graph import positions

    ranked = positions(explained.select("rel_fname", "name", "line", "role_tag", "one_liner", "importance"), F.desc("importance"), "rel_fname", "name", "line")
    out = file_page(ranked, purposes).select(F.concat("rel_fname", F.lit(".md")).alias("path"), "page")
    out = out.unionByName(index_page(ranked, purposes, name).select(F.lit("index.md").alias("path"), "page"))
    return out.unionByName(functions_page(ranked).select(F.lit("functions.md").alias("path"), "page"))


def write_pages(pages_: DataFrame, folder: str) -> int:
    """Write pages(path, page) as files under folder, a URI of a store that all nodes reach or a path mounted on all; returns how many."""
    target = folder.rstrip("/") if "://" in folder else f"file://{folder.rstrip('/')}"

    def write(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for path, page in zip(batch.column("path").to_pylist(), batch.column("page").to_pylist(), strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0])
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(page.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return pages_.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
