"""CodeMap: one object a source tree, a method for each request; every answer is a DataFrame."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import generation
from graphloom.functions import prompts as P
from graphloom.functions import text as T
from graphloom.operators import cache as C
from graphloom.operators import graph as G
from graphloom.operators import passes
from graphloom.operators import vectors as V
from graphloom.plans import digest as D
from graphloom.sources import tree
from graphloom.sources.tables import CacheTable, VectorTable
from graphloom.storage import Scratch, cut, discard


def request(method: Callable[..., Any]) -> Callable[..., Any]:
    """A method whose intermediate tables are the CodeMap's, which deletes them when they are out of use."""

    @functools.wraps(method)
    def run(self: CodeMap, *args: object, **params: object) -> Any:  # noqa: ANN401
        with self.scratch:
            return method(self, *args, **params)

    return run


class CodeMap:
    """A tree's tables, parsed and ranked once by index(); reindex_file() replaces one file's share.

    gitignore: the text of the root .gitignore, read from the tree by default. store: a folder of the vector table and
    the result cache; without one, functions are explained from the call graph alone and nothing is kept.
    """

    def __init__(self, spark: SparkSession, root: str, gitignore: str | None = None, store: str | None = None, embedder=V.hash_embedder) -> None:  # noqa: ANN001
        self.spark, self.root, self.gitignore, self.embedder = spark, root, gitignore, embedder
        self.vectors = VectorTable(spark, store) if store else None
        self.cache = CacheTable(spark, f"{store.rstrip('/')}/cache") if store else None
        self.files = self.tags = self.aliases = self.parts = self.edges = self.importance = self.unreadable = None
        self.scratch, self._before = Scratch(), Scratch()

    # -- index

    def _renewed(self, step: Callable[[], int]) -> int:
        """A step that replaces the index. Tables that requests made, and the replaced ones, go with the second renewal after: what was asked before one is still there after it."""
        self._before.free()
        self._before, self.scratch = self.scratch, Scratch()
        replaced = self._tables()
        with Scratch() as working:
            out = step()
            working.keep(*self._tables())
        working.free()
        self._before.tables += [t for t in replaced if t not in self._tables()]
        return out

    def _tables(self) -> list[DataFrame]:
        return [t for t in (self.files, self.tags, self.aliases, self.parts, self.edges, self.importance, self.unreadable) if t is not None]

    def close(self) -> None:
        """Delete the tables of the index and of its requests."""
        for s in (self._before, self.scratch):
            s.free()
        discard(*self._tables())
        self.files = self.tags = self.aliases = self.parts = self.edges = self.importance = self.unreadable = None

    def _read(self, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(files, unreadable, tags, aliases) of the source files among paths, each read once: tags are of the text that is kept."""
        got = cut(tree.sources(paths, self.root).select("rel_fname", tree.text_of(F.col("content")).alias("content"), "error"), "read")
        files = got.filter("error IS NULL").select("rel_fname", "content")
        parsed = files.select("rel_fname", F.encode("content", "UTF-8").alias("content"))
        return files, got.filter("error IS NOT NULL").select("rel_fname", "error"), tree.parse_tags(parsed), tree.parse_aliases(parsed)

    def index(self, embed: bool = False) -> CodeMap:
        """Parse and rank the tree; embed: fill the vector table too. Files that cannot be read are listed in unreadable(rel_fname, error)."""

        def step() -> int:
            files, unreadable, tags, aliases = self._read(tree.tree_paths(self.spark, self.root, self.gitignore))
            self.files, self.unreadable, self.tags, self.aliases = cut(files, "files"), cut(unreadable, "unreadable"), cut(tags, "tags"), cut(aliases, "aliases")
            self.parts = cut(G.contributions(G.enclosed_refs(self.tags), G.candidates(self.tags, self.aliases)), "parts")
            self._rank(G.fold(self.parts), None)
            return 0

        self._renewed(step)
        if embed and self.vectors is not None:
            self.vectors.replace_all(V.embed_chunks(self.chunks(), self.embedder))
        return self

    def _rank(self, edges: DataFrame, before: DataFrame | None) -> None:
        """before: the importance that an update starts from."""
        self.edges = cut(edges, "edges")
        self.importance = cut(G.pagerank(G.nodes(self.tags), self.edges, start=before), "importance")

    def reindex_file(self, rel_fname: str, embed: bool = False) -> int:
        """reindex_files() of one file."""
        return self.reindex_files([rel_fname], embed)

    def reindex_files(self, files: list[str], embed: bool = False) -> int:
        """Read some files anew, and no others; returns their number of definitions. Files that are gone lose theirs.

        Without an index the whole tree is read; if aliases changed, all references are resolved again.
        """
        if self.tags is None:
            self.index(embed)
            return self.tags.filter(F.col("rel_fname").isin(*files) & (F.col("kind") == "def")).count()
        own = F.col("rel_fname").isin(*files)

        def step() -> int:
            fresh, unreadable, new_tags, new_aliases = self._read(tree.named_paths(self.spark, self.root, files, self.gitignore))
            tags, aliases = cut(self.tags.filter(~own).unionByName(new_tags), "tags"), cut(self.aliases.filter(~own).unionByName(new_aliases), "aliases")
            self.files = cut(self.files.filter(~own).unionByName(fresh), "files")
            self.unreadable = cut(self.unreadable.filter(~own).unionByName(unreadable), "unreadable")
            parts, edges, n = G.reindex(self.parts, self.edges, self.tags, tags, self.aliases, aliases, files)
            self.parts, self.tags, self.aliases = parts, tags, aliases
            self._rank(edges, self.importance)
            return n

        n = self._renewed(step)
        if embed and self.vectors is not None:
            with self.scratch:
                chunks = cut(V.embed_chunks(V.chunk_files(self.files.filter(own)), self.embedder), "chunks")
            for f in files:
                self.vectors.replace_file(f, chunks.filter(F.col("rel_fname") == f))
        return n

    # -- graph

    def status(self) -> dict[str, int]:
        return {"functions": self.importance.count(), "edges": self.edges.count()} if self.edges is not None else {"functions": 0, "edges": 0}

    def list_ranked_functions(self) -> DataFrame:
        return self.importance.orderBy(F.desc("importance"), "rel_fname", "name", "line")

    def index_file(self, rel_fname: str) -> DataFrame:
        own = self.edges.filter((F.col("caller_file") == rel_fname) | (F.col("callee_file") == rel_fname))
        return G.function_context(own, self.importance).filter(F.col("rel_fname") == rel_fname)

    def resolve_function(self, name: str) -> DataFrame:
        return G.best_def(self.spark.createDataFrame([(name,)], "name string"), self.importance)

    def _root(self, rel_fname: str, name: str, line: int) -> DataFrame:
        probe = self.spark.createDataFrame([(0, rel_fname, name, line)], "root long, rel_fname string, name string, at_line int")
        return G.nearest_def(probe, self.tags.filter("kind = 'def'")).filter("line IS NOT NULL").select("root", "rel_fname", "name", "line")

    @request
    def get_blast_radius(self, rel_fname: str, name: str, line: int, depth: int = G.DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
        return G.blast_radius(self.edges, self.importance, self._root(rel_fname, name, line), depth)

    @request
    def get_call_trace(self, rel_fname: str, name: str, line: int, depth: int = G.DEPTH) -> tuple[DataFrame, DataFrame]:
        return G.call_trace(self.edges, self.importance, self._root(rel_fname, name, line), depth)

    @request
    def dump(self) -> DataFrame:
        """(pos, text): every function in order of importance, with its callers and callees."""
        near = G.function_context(self.edges, self.importance)
        entry = F.struct("pos", F.concat("r_file", F.lit(":"), "r_name").alias("n"))
        sides = near.groupBy(*G.NODE, "direction").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["n"]).alias("names"), F.max("omitted").alias("omitted"))
        more = F.when(F.col("omitted") > 0, F.concat(F.lit(" (+"), F.col("omitted").cast("string"), F.lit(" more)"))).otherwise("")
        line = F.concat(F.lit("  "), "direction", F.lit("s ("), F.size("names").cast("string"), more, F.lit("): "), F.array_join("names", ", "))
        sides = sides.groupBy(*G.NODE).agg(F.array_join(F.sort_array(F.collect_list(line), False), "\n").alias("sides"))
        ranked = G.positions(self.importance, F.desc("importance"), "rel_fname", "name", "line")
        head = F.concat("rel_fname", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(" "), "name", F.lit("()  importance="), F.format_string("%.4f", "importance"))
        return ranked.join(sides, G.NODE, "left").select("pos", F.concat_ws("\n", head, "sides").alias("text"))

    # -- functions with their sources and contexts

    def chunks(self) -> DataFrame:
        return V.chunk_files(self.files)

    def functions(self) -> DataFrame:
        """(rel_fname, name, line, end_line, fn_source, fn_id) of every definition; names that repeat in a file are numbered."""
        defs = self.tags.filter("kind = 'def'").groupBy("rel_fname", "name", F.col("start_line").alias("line")).agg(F.min(F.struct("tag_seq", "start_byte", "end_byte", "end_line")).alias("t"))
        source = F.decode(tree.byte_slice(F.encode("content", "UTF-8"), F.col("t.start_byte"), F.col("t.end_byte")), "UTF-8")
        out = defs.join(self.files, "rel_fname").select("rel_fname", "name", "line", F.col("t.end_line").alias("end_line"), source.alias("fn_source"))
        return passes.assign_fn_ids(out.withColumn("rel_file", F.col("rel_fname")).withColumn("qualified", F.col("name")), ["line"]).drop("rel_file", "qualified")

    @request
    def retrieved(self, functions: DataFrame) -> DataFrame | None:
        """(rel_fname, name, line, retrieved); None without a vector table, or where the embedder fails: functions are then explained from the call graph alone."""
        if self.vectors is None or not self.vectors.exists():
            return None
        rows = cut(functions.withColumn("query", F.monotonically_increasing_id()), "asked")
        asked = rows.select("query", "rel_fname", F.col("line").alias("start_line"), F.greatest("end_line", F.col("line") + 1).alias("end_line"), "fn_source")
        try:
            near = cut(V.retrieve(asked, self.vectors.read(), self.embedder), "near")
        except PythonException as e:
            if "GenerationError" not in str(e):
                raise  # a fault of the program
            warnings.warn(f"retrieval failed, going on without it: {str(e).strip().splitlines()[-1]}", stacklevel=2)
            return None
        return near.join(rows.select("query", "rel_fname", "name", "line"), "query").drop("query")

    def targets(self, functions: DataFrame, model_id: str) -> DataFrame:
        """functions with their contexts, hashes and versions: what passes generate from."""
        versions = passes.Versions(model_id, getattr(self.embedder, "model_id", "hash"))
        return passes.wanted(passes.with_context(functions, G.function_context(self.edges, self.importance), self.retrieved(functions)), versions)

    # -- generation

    def generate_explanations(self, model=generation.stub, model_id: str = "stub", **options: object) -> DataFrame:  # noqa: ANN001
        """All functions with explanation and error; nothing is cached."""
        return generation.explain(self.targets(self.functions(), model_id), model, **options)

    @request
    def generate_explanation(self, rel_fname: str, name: str, line: int, fn_source: str, model=generation.stub, model_id: str = "stub") -> DataFrame:  # noqa: ANN001
        """One row: context_hash, context_tier, explanation. A function that the index lacks has an empty context; a failure raises GenerationError."""
        spans = self.tags.filter("kind = 'def'").select("rel_fname", "name", F.col("start_line").alias("line"), "end_line")
        found = self._root(rel_fname, name, line).join(spans, ["rel_fname", "name", "line"]).select("name", "line", "end_line").first()
        row = (rel_fname, name, found["line"] if found else line, found["end_line"] if found else line + 1, fn_source, "")
        one = self.spark.createDataFrame([row], "rel_fname string, name string, line int, end_line int, fn_source string, fn_id string")
        out = cut(generation.explain(self.targets(one, model_id), model), "explanation")
        error = out.first()["error"]
        if error is not None:
            raise generation.GenerationError(error)
        return out.select("context_hash", "context_tier", "explanation")

    @request
    def acceptance_report(self, names: list[str] | None = None, limit: int = 15, model=generation.stub, model_id: str = "stub") -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
        """(one row, text: the Markdown report; the names that no function has) of the named functions, or the first `limit`."""
        ranked = G.positions(self.importance, F.desc("importance"), "rel_fname", "name", "line")
        sample, missing = passes.acceptance_sample(ranked, names, limit)
        functions = self.functions().join(sample.select(*G.NODE, "pos"), G.NODE)
        report = generation.acceptance_report(cut(generation.explain(self.targets(functions, model_id), model), "accepted"))
        return generation.acceptance_markdown(report, self.root.rstrip("/").rsplit("/", 1)[-1], model_id), missing

    @request
    def index_pass(self, top: int | None = 200, model=generation.stub, model_id: str = "stub", **options: object) -> DataFrame:  # noqa: ANN001
        """Explain and cache the first `top` functions (all: None) that the cache lacks; (fn_id, fn_hash, outcome, error)."""
        functions = self.functions()
        if top is not None:
            functions = functions.join(self.list_ranked_functions().limit(top).select(*G.NODE), G.NODE, "left_semi")
        return passes.index_pass(self.cache, cut(self.targets(functions, model_id), "targets"), model=model, **options)

    @request
    def refresh(self, rel_fname: str, name: str, line: int, dirty: DataFrame, stale: DataFrame, model=generation.stub, model_id: str = "stub") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
        """Explain one function anew, cached or not; (outcomes, dirty, stale) after it."""
        one = self.functions().join(self._root(rel_fname, name, line).select("rel_fname", "name", "line"), ["rel_fname", "name", "line"], "left_semi")
        return passes.refresh(self.cache, self.targets(one, model_id), dirty, stale, model=model)

    def explained(self, model_id: str = "stub") -> DataFrame:
        """Every function with cache_key, role_tag and one_liner of its cache row; nulls where it has none."""
        rows = passes.wanted(self.functions(), passes.Versions(model_id, getattr(self.embedder, "model_id", "hash")))
        if self.cache is None:
            null = F.lit(None).cast("string")
            return rows.withColumn("cache_key", null).withColumn("role_tag", null).withColumn("one_liner", null)
        return C.enrich(rows, self.cache.read())

    def generate_file_summary(self, model=generation.stub, model_id: str = "stub") -> DataFrame:  # noqa: ANN001
        """(rel_fname, summary, error): the model's paragraph on each file's functions, most important first."""
        rows = self.explained(model_id).join(self.importance, G.NODE)
        entry = F.struct((-F.col("importance")).alias("o"), "name", "line", F.struct("name", "role_tag", "one_liner").alias("f"))
        lists = rows.groupBy("rel_fname").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["f"]).alias("functions"))
        said = lists.withColumn("said", generation.generate(P.file_summary_prompt(F.col("rel_fname"), F.col("functions")), model))
        return said.select("rel_fname", F.trim("said.text").alias("summary"), "said.error")

    @request
    def generate_cluster_summary(self, rel_fname: str, name: str, line: int, model=generation.stub, model_id: str = "stub") -> DataFrame:  # noqa: ANN001
        """(root, summary, error): the model's paragraph on a function and those of its upstream callers that are explained."""
        nodes, _, _ = self.get_blast_radius(rel_fname, name, line)
        known = self.explained(model_id).select(*G.NODE, "role_tag", "one_liner")
        entry = F.struct("depth", (-F.col("importance")).alias("o"), F.struct("name", "role_tag", "one_liner", "depth").alias("f"))
        callers = nodes.join(known.filter("role_tag IS NOT NULL OR one_liner IS NOT NULL"), G.NODE).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["f"]).alias("callers"))
        root = self._root(rel_fname, name, line).join(known, G.NODE, "left").select("name", "role_tag", "one_liner")
        said = root.join(callers).withColumn("said", generation.generate(P.cluster_summary_prompt(F.col("name"), F.col("role_tag"), F.col("one_liner"), F.col("callers")), model))  # one row each
        return said.select(F.col("name").alias("root"), F.trim("said.text").alias("summary"), "said.error")

    @request
    def write_pages(self, folder: str, model=generation.stub, model_id: str = "stub") -> int:  # noqa: ANN001
        """Write a Markdown page for each file with explained functions, and index.md and functions.md; returns how many."""
        rows = self.explained(model_id).filter("cache_key IS NOT NULL").join(self.importance, G.NODE)
        rows = cut(rows, "explained")
        purposes = cut(self.generate_file_summary(model, model_id).select("rel_fname", F.coalesce("summary", F.lit("_(purpose not available)_")).alias("purpose")), "purposes")
        name = self.root.rstrip("/").rsplit("/", 1)[-1]
        return D.write_pages(D.pages(rows, purposes, name), folder)

    # -- commands over the cache

    def most_important(self, n: int = 20, model_id: str = "stub") -> DataFrame:
        """The first n functions with what is known of them, as one line."""
        top = self.list_ranked_functions().limit(n)
        rows = top.join(self.explained(model_id).select(*G.NODE, "role_tag", "one_liner"), G.NODE, "left")
        return rows.withColumn("detail", T.detail_line(F.col("role_tag"), F.col("one_liner"))).orderBy(F.desc("importance"), *G.NODE)

    def search(self, query: str = "", model_id: str = "stub") -> DataFrame:
        """(fn_id, label, description, detail, match) of the explained functions that match, by label in a reader's order; an empty query lists all."""
        rows = C.current_for_versions(self.cache.read(), model_id, getattr(self.embedder, "model_id", "hash"), passes.Versions(model_id).prompt_version)
        detail = T.detail_line(T.json_string(F.col("explanation_json"), "role_tag"), T.json_string(F.col("explanation_json"), "one_liner"))
        rows = rows.select("fn_id", T.id_qualified(F.col("fn_id")).alias("label"), T.id_file(F.col("fn_id")).alias("description"), detail.alias("detail"))
        match = F.greatest(*[T.subsequence_match(F.coalesce(c, F.lit("")), query) for c in ("label", "description", "detail")])
        return rows.withColumn("match", match).filter("match > 0").orderBy(F.collate("label", "UNICODE"), "fn_id")

    @request
    def prioritize_file(self, rel_fname: str, model=generation.stub, model_id: str = "stub", **options: object) -> DataFrame:  # noqa: ANN001
        """Explain and cache one file's functions that the cache lacks; (fn_id, fn_hash, outcome, error)."""
        own = self.functions().filter(F.col("rel_fname") == rel_fname)
        return passes.index_pass(self.cache, cut(self.targets(own, model_id), "targets"), model=model, **options)

    def purge_cache(self) -> int:
        """Delete superseded rows of the cache; returns how many."""
        return self.cache.purge()

    @request
    def show_blast_radius(self, rel_fname: str, name: str, line: int, model_id: str = "stub") -> DataFrame:
        """The upstream callers by depth, each with what is known of it."""
        nodes, _, _ = self.get_blast_radius(rel_fname, name, line)
        return nodes.join(self.explained(model_id).select(*G.NODE, "role_tag", "one_liner"), G.NODE, "left").orderBy("depth", F.desc("importance"), *G.NODE)

    @request
    def generate_digest(self) -> DataFrame:
        """One row: text, total_files, included_files, truncated."""
        from graphloom.functions.text import binary_head

        paths = tree.tree_paths(self.spark, self.root, self.gitignore).select(F.col("rel_fname").alias("rel_path"), F.col("length").cast("long").alias("size_bytes"))
        paths = cut(D.walk(paths), "digest-paths")  # only files of the walk, and only those small enough, are opened
        fits = F.col("size_bytes") <= D.MAX_BYTES
        read = tree.with_content(paths.filter(fits).withColumnRenamed("rel_path", "rel_fname"), self.root).withColumnRenamed("rel_fname", "rel_path")
        files = read.unionByName(paths.filter(~fits), allowMissingColumns=True)
        binary, text = F.coalesce(binary_head(F.col("content")), F.lit(False)), F.coalesce(tree.text_of(F.col("content")), F.lit(""))
        files = files.select("rel_path", "place", "size_bytes", binary.alias("binary"), F.col("error").isNotNull().alias("unreadable"), F.when(binary, "").otherwise(text).alias("content"))
        files = cut(D.with_budget(files.withColumn("chars", F.length("content").cast("long"))), "digest")
        summary = D.digest_summary(files)
        text = D.render(self.root.rstrip("/").rsplit("/", 1)[-1], summary, D.tree(files.select("rel_path")), files)
        return text.join(summary.select("total_files", "included_files", "truncated"))  # one row each

    # -- requests

    def call(self, method: str, **params: object) -> object:
        """A request by name; unknown ones raise."""
        if method not in METHODS:
            raise ValueError(f"unknown method: {method}")
        return getattr(self, method)(**params)

    def dispatch(self, message: dict) -> dict:
        """A message (id, method, params) answered with its id and either result or error: no request ends the service."""
        try:
            return {"id": message.get("id"), "result": self.call(str(message.get("method")), **(message.get("params") or {}))}
        except Exception as e:  # noqa: BLE001  whatever goes wrong is the request's answer
            text = str(e) if isinstance(e, ValueError) and str(e).startswith("unknown method") else f"{type(e).__name__}: {e}"
            return {"id": message.get("id"), "error": {"message": text}}


#: The requests.
METHODS = (
    "status", "index_file", "generate_explanation", "reindex_file", "resolve_function", "list_ranked_functions", "get_blast_radius", "get_call_trace", "generate_file_summary", "generate_cluster_summary", "generate_digest",
)
