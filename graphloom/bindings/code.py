"""Parsing of a fixed source tree, and generation over the functions of the parts table with models made of rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.bindings import corpus
from graphloom.bindings.tables import read, registry
from graphloom.functions import generation as N
from graphloom.operators import graph as G
from graphloom.operators import passes
from graphloom.sources import tree
from graphloom.sources.manifest import extension_table
from graphloom.sources.tables import CacheTable
from graphloom.storage import cut, shared_dir, shuffled
from graphloom.streaming.background import BackgroundPass

QUERIES, ORACLE_SQL, query = registry()


#: Extensions of the sources made of parts, by the key's remainder; the last one is of no supported language.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".rb")


#: Parts whose sources one task makes and parses.
PARTS_PER_TASK = 5_000


def dealt(spark, sf):
    """The parts dealt over tasks by their number: a small file of parts is large in sources, and would be parsed in one task."""
    p = read(spark, sf, "part")
    return p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // PARTS_PER_TASK)), "p_partkey")


def chain(spark, sf):
    """A source file for each part, whose function calls that of the next part: some by an alias that the next one's file declares, those in .tsx name a component instead."""
    k, n = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    kind = F.col("p_partkey") % len(EXTENSIONS)
    called = F.concat(F.when(F.col("p_partkey") % 10 == 0, "Close").otherwise("f"), n)
    alias = F.when(F.col("p_partkey") % 10 == 1, F.concat(F.lit("Box.Close"), k, F.lit(" = f"), k, F.lit(";\n"))).otherwise("")
    text = (
        F.when(kind == 0, F.concat(F.lit("def f"), k, F.lit("():\n    return "), called, F.lit("()\n"))).when(kind == 1, F.concat(F.lit("function f"), k, F.lit("() {\n  return f"), n, F.lit("();\n}\n"), alias))
        .when(kind == 2, F.concat(F.lit("const f"), k, F.lit(" = (a: number): number => f"), n, F.lit("(a);\n"))).when(kind == 3, F.concat(F.lit("export function f"), k, F.lit("() {\n  return <Box"), n, F.lit(" />;\n}\n"))).otherwise("def none; end")
    )
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (kind + 1).cast("int"))
    return dealt(spark, sf).select(F.concat(F.lit("src/p"), k, ext).alias("rel_fname"), F.encode(text, "UTF-8").alias("content"))


def library(spark, sf):
    """The files of corpus in a folder of each part, each with a comment of the part's name at its end."""
    one = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text in corpus.FILES.items()]))
    mark = F.when(F.endswith("f.path", F.lit(".py")), "# ").when(F.endswith("f.path", F.lit(".rb")), "# ").otherwise("// ")
    rows = dealt(spark, sf).select("p_partkey", "p_name", one.alias("f"))
    return rows.select(F.concat(F.lit("lib/"), F.col("p_partkey").cast("string"), F.lit("/"), "f.path").alias("rel_fname"), F.encode(F.concat("f.text", mark, "p_name", F.lit("\n")), "UTF-8").alias("content"))


def files(spark, sf):
    return tree.with_language(chain(spark, sf).unionByName(library(spark, sf)))


_SRC = f"src AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, 'src/p' || p_partkey || ({list(EXTENSIONS)})[(p_partkey % 5 + 1)::INTEGER] AS file FROM part)"
_LIB = "SELECT 'lib/' || p_partkey || '/' || rel_fname AS rel_fname"


@query("s2_corpus_languages", f"""WITH {_SRC}, c AS ({corpus.values([("web/list.ts", "typescript"), ("web/api.js", "javascript"), ("web/view.tsx", "typescriptreact"), ("tool/run.py", "python"), ("tool/broken.py", "python")], "rel_fname", "language")})
SELECT file AS rel_fname, (['python', 'javascript', 'typescript', 'typescriptreact'])[(kind + 1)::INTEGER] AS language FROM src WHERE kind < 4 UNION ALL {_LIB}, language FROM part, c""")
def _languages(spark, sf):
    return files(spark, sf).select("rel_fname", "language")


@query("s7_parse_tags", f"""WITH {_SRC}, c AS ({corpus.values(corpus.TAGS, "rel_fname", "name", "kind", "start_line", "end_line")})
SELECT file AS rel_fname, 'f' || k AS name, 'def' AS kind, 0 AS start_line, ([1, 2, 0, 2])[(kind + 1)::INTEGER] AS end_line FROM src WHERE kind < 4
UNION ALL SELECT file, CASE WHEN kind = 3 THEN 'Box' WHEN k % 10 = 0 THEN 'Close' ELSE 'f' END || (k + 1), 'ref', ([1, 1, 0, 1])[(kind + 1)::INTEGER], ([1, 1, 0, 1])[(kind + 1)::INTEGER] FROM src WHERE kind < 4
UNION ALL {_LIB}, name, kind, start_line, end_line FROM part, c""")
def _tags(spark, sf):
    return tree.parse_tags(files(spark, sf)).select("rel_fname", "name", "kind", "start_line", "end_line")


@query("s9_aliases", f"""WITH {_SRC}, c AS ({corpus.values(corpus.ALIASES, "rel_fname", "name", "target_name")})
SELECT file AS rel_fname, 'Close' || k AS name, 'f' || k AS target_name FROM src WHERE k % 10 = 1 UNION ALL {_LIB}, name, target_name FROM part, c""")
def _aliases(spark, sf):
    return tree.parse_aliases(files(spark, sf))


@query("g9_index_tree", f"""WITH {_SRC} SELECT a.file AS caller_file, 'f' || a.k AS caller_name, b.file AS callee_file, 'f' || b.k AS callee_name, 1::BIGINT AS weight, true AS confident
FROM src a JOIN src b ON b.k = a.k + 1 WHERE a.kind < 3""")
def _index(spark, sf):
    f = cut(tree.with_language(chain(spark, sf)), "chain")
    return G.call_graph(tree.parse_tags(f), tree.parse_aliases(f)).select("caller_file", "caller_name", "callee_file", "callee_name", "weight", "confident")


@query("g9_index_corpus", f"""WITH c AS ({corpus.values(corpus.EDGES, "caller_file", "caller_name", "callee_file", "callee_name", "weight", "confident")}), n AS (SELECT count(*)::BIGINT AS n FROM part)
SELECT 'lib/' || p_partkey || '/' || caller_file AS caller_file, caller_name, 'lib/' || p_partkey || '/' || callee_file AS callee_file, callee_name, weight::BIGINT AS weight, caller_file = callee_file OR confident AND n = 1 AS confident FROM part, c, n""")
def _index_corpus(spark, sf):
    """The edges within each part's own folder; names repeat in all of them, so only those of one file are sure."""
    f = cut(tree.with_language(library(spark, sf)), "library")
    folder = lambda c: F.substring_index(c, "/", 2)
    t = cut(tree.parse_tags(f), "library-tags")
    refs, found = G.enclosed_refs(t), G.candidates(t, tree.parse_aliases(f))
    both = refs.withColumn("home", folder(F.col("caller_file"))).join(found.withColumn("home", folder(F.col("callee_file"))), ["home", "name"])
    sure = (F.col("total") == 1) | (F.col("caller_file") == F.col("callee_file"))
    parts = both.select(*G.CALLER, *G.CALLEE, (F.col("refs") * F.col("tags")).alias("weight"), sure.alias("confident"))
    return G.fold(parts).select("caller_file", "caller_name", "callee_file", "callee_name", "weight", "confident")


@query("s10_manifest", f"""WITH {_SRC}, m AS (SELECT * FROM (VALUES ('.js', 'javascript'), ('.jsx', 'javascript'), ('.ts', 'typescript'), ('.tsx', 'typescriptreact'), ('.py', 'python')) t(ext, language))
SELECT ext, language, count(file)::BIGINT AS files FROM m LEFT JOIN src ON regexp_extract(file, '[.][^.]*$') = ext GROUP BY ext, language""")
def _manifest(spark, sf):
    """The files of the parts' sources by the manifest's extensions."""
    ext = chain(spark, sf).select(F.concat(F.lit("."), F.substring_index("rel_fname", ".", -1)).alias("ext"), "rel_fname")
    return extension_table(spark).join(ext, "ext", "left").groupBy("ext", "language").agg(F.count("rel_fname").alias("files"))


#: Folders that parts lie in, by the key's remainder, and whether each language's walk leaves them out.
FOLDERS = (("node_modules", True), ("out", True), ("dist", True), ("build", True), ("__pycache__", True), (".venv", True), ("venv", True), (".mypy_cache", True), (".pytest_cache", True), (".tox", True), ("x.egg-info", True), ("src", False), ("outer", False), ("egg-info", False), (".git", False))


@query("u6_excluded_dirs_union", f"SELECT 'a/' || ({[d for d, _ in FOLDERS]})[(p_partkey % {len(FOLDERS)} + 1)::INTEGER] || '/p' || p_partkey || '.py' AS rel_fname, ({[int(x) for _, x in FOLDERS]})[(p_partkey % {len(FOLDERS)} + 1)::INTEGER] = 1 AS excluded FROM part")
def _excluded(spark, sf):
    folder = F.element_at(F.array(*[F.lit(d) for d, _ in FOLDERS]), (F.col("p_partkey") % len(FOLDERS) + 1).cast("int"))
    path = F.concat(F.lit("a/"), folder, F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return read(spark, sf, "part").select(path.alias("rel_fname")).withColumn("excluded", tree.in_excluded_dir(F.col("rel_fname")))


#: The part of a part's name on which the model gives up.
FAILS = "red"


def reasoner(prompt: str) -> str:
    """Free text about the function that the prompt ends with, and a brace at which it has to stop."""
    source = prompt.rpartition("Function source:\n")[2].partition("\n\n")[0]
    if source.partition(" ")[2].startswith(FAILS):
        raise N.GenerationError.of(503, "rules", "busy")
    return f" About {source}. " + "{ never read }"


def answerer(prompt: str) -> str:
    """The explanation as JSON, with a caller and a callee that do not exist."""
    import json

    source = prompt.partition("Function source:\n")[2].partition("\n\n")[0]
    said = prompt.rpartition("Reasoning:")[2].partition("\n\nJSON:")[0].strip()
    if source.endswith("ring"):
        return "no JSON at all"
    return json.dumps({"role_tag": "helper", "one_liner": said, "why_it_exists": "w", "used_by": ["up", "ghost"], "calls": ["ghost"], "side_effects": [], "risk_note": None})


def targets(spark, sf):
    """The parts as functions, each called by one function named up."""
    p = read(spark, sf, "part").select(F.col("p_brand").alias("rel_fname"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("line"), F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name").alias("fn_source"), F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("fn_id"))
    near = p.select("rel_fname", "name", "line", F.lit("caller").alias("direction"), F.lit(1).alias("pos"), F.col("rel_fname").alias("r_file"), F.lit("up").alias("r_name"), F.lit(7).alias("r_line"), F.lit(0).cast("long").alias("omitted"))
    return passes.wanted(passes.with_context(p, near), passes.Versions("rules"))


OUTCOME = f"CASE WHEN starts_with(p_name, '{FAILS}') THEN 'the model server answered 503: busy' WHEN ends_with(p_name, 'ring') THEN 'the answer is no JSON object' END"


@query("x4_two_stages", f"SELECT 'fn' || p_partkey AS fn_id, {OUTCOME} AS error, CASE WHEN {OUTCOME} IS NULL THEN 'About ' || p_partkey || ' ' || p_name || '.' END AS one_liner, CASE WHEN {OUTCOME} IS NULL THEN 'up' END AS used_by, CASE WHEN {OUTCOME} IS NULL THEN 0 END::INTEGER AS calls FROM part")
def _explain(spark, sf):
    e = F.col("explanation")
    return N.explain(targets(spark, sf), answerer, reasoner).select("fn_id", "error", e["one_liner"].alias("one_liner"), F.array_join(e["used_by"], ",").alias("used_by"), F.when(e.isNotNull(), F.size(e["calls"])).alias("calls"))


CONTEXT = "sha256(sha256('caller:' || p_brand || ':up:7'))"


@query("x10_generate_and_cache", f"""SELECT 'fn' || p_partkey AS fn_id, CASE WHEN {OUTCOME} IS NULL THEN 'generated' ELSE 'failed' END AS first_pass, CASE WHEN {OUTCOME} IS NULL THEN 'skipped' ELSE 'failed' END AS second_pass,
CASE WHEN {OUTCOME} IS NULL THEN sha256(p_partkey || ' ' || p_name || {CONTEXT} || 'rules' || 'hash' || 'v1') END AS cache_key FROM part""")
def _passes(spark, sf):
    """Two passes over the same functions: the second one skips what the first one cached, and tries the others again."""
    table = CacheTable(spark, f"{shared_dir(spark)}/graphloom/tables-{uuid.uuid4().hex}")
    wanted = cut(targets(spark, sf), "targets")
    first = passes.index_pass(table, wanted, model=answerer, reason=reasoner).select("fn_id", F.col("outcome").alias("first_pass"))
    second = passes.index_pass(table, wanted, model=answerer, reason=reasoner).select("fn_id", F.col("outcome").alias("second_pass"))
    return first.join(second, "fn_id").join(table.read().select("fn_id", "cache_key"), "fn_id", "left")


@query("r7_paused_pass", f"""SELECT fn_id, outcome, batch::BIGINT AS batch, batch < 2 AS before_pause, outcome = 'generated' AS cached FROM (
SELECT 'fn' || p_partkey AS fn_id, CASE WHEN {OUTCOME} IS NULL THEN 'generated' ELSE 'failed' END AS outcome, (row_number() OVER (ORDER BY p_partkey) - 1) // ceil(count(*) OVER () / 4)::BIGINT AS batch FROM part)""")
def _paused(spark, sf):
    """A pass over all parts in four batches that pauses after two, and is resumed by another object over the same folder."""
    folder = f"{shared_dir(spark)}/graphloom/pass-{uuid.uuid4().hex}"
    table = CacheTable(spark, f"{folder}/cache")
    new = lambda: BackgroundPass(spark, folder, table, model=answerer, reason=reasoner)
    new().plan(targets(spark, sf), ["line"], -(-read(spark, sf, "part").count() // 4))
    new().run(batches=2)
    paused = cut(new().outcomes().select("fn_id", F.lit(True).alias("before_pause")), "paused")
    new().run()
    held = table.read().select("fn_id", F.lit(True).alias("cached"))
    out = new().outcomes().join(shuffled(paused), "fn_id", "left").join(shuffled(held), "fn_id", "left")
    return out.select("fn_id", "outcome", "batch", F.coalesce("before_pause", F.lit(False)).alias("before_pause"), F.coalesce("cached", F.lit(False)).alias("cached"))


def _saved(spark, sf):
    """A save of all parts, after a pass over them in which those of even keys had another source; each part calls the next one."""
    table, now = CacheTable(spark, f"{shared_dir(spark)}/graphloom/tables-{uuid.uuid4().hex}"), cut(targets(spark, sf), "targets")
    old = now.withColumn("fn_source", F.when(F.col("line") % 2 == 0, F.concat(F.lit("0"), "fn_source")).otherwise(F.col("fn_source"))).drop("fn_hash", *passes.C.VERSION)
    passes.index_pass(table, passes.wanted(old, passes.Versions("rules")), model=answerer, reason=reasoner)
    near = now.select("rel_fname", "name", "line", F.col("rel_fname").alias("r_file"), F.concat(F.lit("f"), (F.col("line") + 1).cast("string")).alias("r_name"), (F.col("line") + 1).alias("r_line"))
    return passes.save_pass(table, now, near, model=answerer, reason=reasoner)


@query("r2_save_pass", f"SELECT 'fn' || p_partkey AS fn_id, CASE WHEN {OUTCOME} IS NOT NULL THEN 'failed' WHEN p_partkey % 2 = 0 THEN 'regenerated' ELSE 'skipped' END AS outcome, {OUTCOME} IS NULL AND p_partkey % 2 = 0 AS changed FROM part")
def _save_pass(spark, sf):
    return _saved(spark, sf)[0].select("fn_id", "outcome", "changed")


@query("r5_stale_after_save", f"SELECT p_brand AS rel_fname, 'f' || (p_partkey + 1) AS name, p_partkey + 1 AS line FROM part WHERE {OUTCOME} IS NULL AND p_partkey % 2 = 0")
def _stale_after_save(spark, sf):
    return _saved(spark, sf)[1]


@query("x11_refresh", f"SELECT 'fn' || p_partkey AS fn_id, CASE WHEN {OUTCOME} IS NULL THEN 'generated' ELSE 'failed' END AS outcome, {OUTCOME} IS NOT NULL AS dirty, {OUTCOME} IS NOT NULL AND p_partkey % 2 = 0 AS stale FROM part")
def _refresh(spark, sf):
    """All functions generated anew, cached or not; those that fail stay dirty, and stale if they were."""
    table = CacheTable(spark, f"{shared_dir(spark)}/graphloom/tables-{uuid.uuid4().hex}")
    wanted = cut(targets(spark, sf), "targets")
    passes.index_pass(table, wanted, model=answerer, reason=reasoner)
    marks = wanted.select("fn_id")
    outcomes, dirty, stale = passes.refresh(table, wanted, marks, wanted.filter("line % 2 = 0").select("fn_id"), model=answerer, reason=reasoner)
    left = lambda m, name: m.select("fn_id", F.lit(True).alias(name))
    out = outcomes.join(left(dirty, "dirty"), "fn_id", "left").join(left(stale, "stale"), "fn_id", "left")
    return out.select("fn_id", "outcome", F.coalesce("dirty", F.lit(False)).alias("dirty"), F.coalesce("stale", F.lit(False)).alias("stale"))


@query("x5_file_summaries", f"SELECT p_brand AS rel_fname, 'Summary of ' || count(*) || ' lines' AS summary, NULL::VARCHAR AS error FROM part GROUP BY 1")
def _summaries(spark, sf):
    from graphloom.functions import prompts as P

    none = F.lit(None).cast("string")
    entry = F.struct(F.col("p_name").alias("name"), none.alias("role_tag"), none.alias("one_liner"))
    g = read(spark, sf, "part").groupBy(F.col("p_brand").alias("rel_fname")).agg(F.collect_list(entry).alias("functions"))
    said = g.withColumn("said", N.generate(P.file_summary_prompt(F.col("rel_fname"), F.col("functions")), lambda p: f"  Summary of {p.count(': no summary')} lines\n"))
    return said.select("rel_fname", F.btrim("said.text", F.lit(" \n")).alias("summary"), "said.error")


@query("k8_acceptance_report", f"""WITH s AS (SELECT *, {OUTCOME} AS error, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part QUALIFY pos <= 15)
SELECT md5('# Acceptance report: parts' || chr(10) || chr(10) || '- Model: `rules`' || chr(10) || '- Functions: ' || count(*) || chr(10) || '- Passed: ' || count_if(error IS NULL) || ' of ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| string_agg('## `f' || p_partkey || '`, ' || p_brand || ':' || p_partkey || ' [' || CASE WHEN error IS NULL THEN 'passed' ELSE '1 issue(s)' END || ']' || chr(10) || chr(10) || CASE WHEN error IS NULL THEN '' ELSE '**Issues:**' || chr(10) || '- no valid answer' || chr(10) || chr(10) END
|| CASE WHEN error IS NULL THEN '**Notes:**' || chr(10) || '- names no neighbour' || chr(10) || chr(10) ELSE '' END || '**Callers:** up' || chr(10) || '**Callees:** none' || chr(10) || chr(10) || '```' || chr(10) || p_partkey || ' ' || p_name || chr(10) || '```' || chr(10) || chr(10) || '```json' || chr(10)
|| CASE WHEN error IS NULL THEN '{{"role_tag":"helper","one_liner":"About ' || p_partkey || ' ' || p_name || '.","why_it_exists":"w","used_by":["up"],"calls":[],"side_effects":[]}}' ELSE 'null' END || chr(10) || '```' || chr(10) || chr(10) || '**Verdict:** [ ] correct and not obvious [ ] wrong, obvious or generic' || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY pos)) AS digest FROM s""")
def _report(spark, sf):
    from pyspark.sql import Window

    top = read(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("pos"))
    sample = targets(spark, sf).join(F.broadcast(top), F.col("line") == F.col("p_partkey"))  # fifteen rows, as the report has it
    report = N.acceptance_report(N.explain(sample, answerer, reasoner))
    return N.acceptance_markdown(report, "parts", "rules").select(F.md5("text").alias("digest"))
