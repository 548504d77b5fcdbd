"""Passes that generate: cache rows for functions, generate-and-cache, refresh, a save and a flush, with what they change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import generation
from graphloom.functions import text as T
from graphloom.operators import cache as C
from graphloom.operators.change import stale_dependents
from graphloom.storage import cut, shuffled


NODE = ["rel_fname", "name", "line"]


@dataclass(frozen=True)
class Versions:
    """What a cache row depends on besides its function."""

    model_id: str
    embedding_model_id: str = "hash"
    prompt_version: str = "v1"

    def columns(self) -> list[Column]:
        return [F.lit(self.model_id).alias("model_id"), F.lit(self.embedding_model_id).alias("embedding_model_id"), F.lit(self.prompt_version).alias("prompt_version")]


def wanted(functions: DataFrame, versions: Versions) -> DataFrame:
    """functions(fn_id, fn_source, ...) with fn_hash and the versions: the columns that a cache lookup needs."""
    return functions.withColumn("fn_hash", T.sha256(F.col("fn_source"))).select("*", *versions.columns())


def with_context(functions: DataFrame, callers: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """functions(rel_fname, name, line, ...) with callers, callees, their left-out counts, retrieved, context_hash and context_tier.

    callers: function_context()'s rows. retrieved(rel_fname, name, line, retrieved): chunks a function, or None.
    """
    node = ["rel_fname", "name", "line"]
    entry = F.struct("pos", F.struct(F.col("r_name").alias("name"), F.col("r_file").alias("file"), F.col("r_line").alias("line")).alias("n"))
    side = lambda d: callers.filter(F.col("direction") == d).groupBy(*node).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["n"]).alias(f"{d}s"), F.max("omitted").alias(f"{d}s_omitted")
    )
    out = functions.join(shuffled(side("caller")), node, "left").join(shuffled(side("callee")), node, "left")
    kind = dict(side("caller").dtypes)["callers"]
    for c in ("callers", "callees"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(kind))).withColumn(f"{c}_omitted", F.coalesce(f"{c}_omitted", F.lit(0).cast("long")))
    none = F.array().cast("array<struct<rel_fname:string,start_line:int,end_line:int,text:string>>")
    out = out.withColumn("retrieved", none) if retrieved is None else out.join(shuffled(retrieved), node, "left").withColumn("retrieved", F.coalesce("retrieved", none))
    digest = T.context_hash(F.col("callers"), F.col("callers_omitted"), F.col("callees"), F.col("callees_omitted"), F.col("retrieved"))
    return out.withColumn("context_hash", digest).withColumn("context_tier", T.context_tier(F.col("retrieved")))


def generate_rows(targets: DataFrame, model: generation.Model = generation.stub, reason: generation.Model | None = None, timeout: float = generation.TIMEOUT) -> DataFrame:
    """Rows for the cache of targets(wanted(), with_context()): its columns but seq, and error, null where an explanation was made.

    The model runs once a target: write the result (see cut) before it is used twice.
    """
    made = generation.explain(targets, model, reason, timeout)
    key = T.cache_key(F.col("fn_source"), F.col("context_hash"), F.col("model_id"), F.col("embedding_model_id"), F.col("prompt_version"))
    text = F.to_json("explanation", {"ignoreNullFields": "false"})
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return made.select(
        key.alias("cache_key"), "fn_id", F.when(F.col("error").isNull(), text).alias("explanation_json"), "fn_hash", "context_hash", *C.VERSION, "context_tier", now.alias("generated_at"), "error"
    )


def generate_and_cache(table, targets: DataFrame, **options: object) -> DataFrame:  # noqa: ANN001
    """(fn_id, fn_hash, outcome, error) of targets: all are generated, and what succeeds is written to the CacheTable."""
    rows = cut(generate_rows(targets, **options), "generated")
    table.write(rows.filter("error IS NULL").drop("error"))
    return rows.select("fn_id", "fn_hash", F.when(F.col("error").isNull(), "generated").otherwise("failed").alias("outcome"), "error")


def index_pass(table, targets: DataFrame, **options: object) -> DataFrame:  # noqa: ANN001
    """(fn_id, fn_hash, outcome, error): targets that the CacheTable holds are skipped, the others generated; a second pass generates nothing that the first one made."""
    held = table.read()
    skipped = cut(C.cached(targets, held).select("fn_id", "fn_hash", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("error")), "skipped")
    return skipped.unionByName(generate_and_cache(table, C.uncached(targets, held), **options))


def save_outcomes(functions: DataFrame, cache: DataFrame, generated: DataFrame) -> DataFrame:
    """functions(fn_id, LOOKUP) of a saved file with outcome and changed, as a save pass finds and leaves them.

    A function with a row of its hash is 'skipped'; of the others, those in generated(fn_id) are 'regenerated', the
    rest 'failed'. changed: regenerated, and the row that was current before had another hash (a first one is none).
    """
    prior = C.current_rows(cache).select(*C.TUPLE, F.col("fn_hash").alias("prior_hash"))
    hit = cache.select(*C.LOOKUP).distinct().withColumn("hit", F.lit(True))
    done = generated.select("fn_id").distinct().withColumn("done", F.lit(True))
    out = functions.join(shuffled(hit), C.LOOKUP, "left").join(shuffled(prior), C.TUPLE, "left").join(shuffled(done), "fn_id", "left")
    outcome = F.when(F.col("hit"), "skipped").when(F.col("done"), "regenerated").otherwise("failed")
    out = out.withColumn("outcome", outcome)
    changed = (F.col("outcome") == "regenerated") & F.coalesce(F.col("prior_hash") != F.col("fn_hash"), F.lit(False))
    return out.select(*functions.columns, "outcome", changed.alias("changed"))


def save_pass(table, targets: DataFrame, context: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(outcomes, stale) of the targets of saved files, with their cache rows: (NODE, fn_id, LOOKUP, outcome, changed) as save_outcomes() has it, and the nodes that become stale.

    Functions that the cache holds are skipped, the others generated and written. The capped callers and callees
    (context: function_context()'s rows) of those that changed become stale, but for what was generated as well.
    """
    held = table.read()  # what is written below does not change it
    done = index_pass(table, targets, **options).filter("outcome = 'generated'")
    return _settled(save_outcomes(targets.select(*NODE, *C.LOOKUP), held, done), context)


def flush_pass(table, dirty: DataFrame, targets: DataFrame, context: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(outcomes, stale) of dirty(fn_id): (NODE, fn_id, outcome, changed). 'vanished' has no target, 'unchanged' is cached as it is, the others are generated: 'regenerated', or 'failed', which stay dirty."""
    held = table.read()
    own = cut(targets.join(shuffled(dirty.select("fn_id").distinct()), "fn_id", "left_semi"), "flushed")
    done = generate_and_cache(table, C.uncached(own, held), **options).filter("outcome = 'generated'")
    found = save_outcomes(own.select(*NODE, *C.LOOKUP), held, done)
    found = found.withColumn("outcome", F.when(F.col("outcome") == "skipped", "unchanged").otherwise(F.col("outcome"))).select(*NODE, "fn_id", "outcome", "changed")
    gone = dirty.select("fn_id").distinct().join(own.select("fn_id"), "fn_id", "left_anti").select("fn_id", F.lit("vanished").alias("outcome"), F.lit(False).alias("changed"))
    return _settled(found.unionByName(gone, allowMissingColumns=True), context)


def _settled(outcomes: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    outcomes = cut(outcomes, "outcomes")
    return outcomes, stale_dependents(outcomes.filter("changed"), context, outcomes.filter("outcome = 'regenerated'"))


def events_of(outcomes: DataFrame, stale: DataFrame, seqs: DataFrame) -> DataFrame:
    """(seq, file, fn, kind): what a pass tells the freshness machine. seqs(fn_id, file, seq): up to which event the pass read each function; failed ones stay as they are.

    stale(fn_id, file, ...) is told with the greatest of these seqs.
    """
    kind = F.when(F.col("outcome") == "regenerated", "regenerate").when(F.col("outcome").isin("vanished", "unchanged"), "flush")
    told = outcomes.join(seqs, "fn_id").select("seq", "file", F.col("fn_id").alias("fn"), kind.alias("kind")).filter("kind IS NOT NULL")
    last = seqs.agg(F.max("seq").alias("seq"))
    return told.unionByName(stale.select("file", F.col("fn_id").alias("fn"), F.lit("stale").alias("kind")).join(F.broadcast(last)).select("seq", "file", "fn", "kind"))  # one row


def after_regeneration(marks: DataFrame, regenerated: DataFrame) -> DataFrame:
    """marks(fn_id, ...), dirty or stale, without the functions that were regenerated: only that clears them."""
    return marks.join(regenerated.select("fn_id").distinct(), "fn_id", "left_anti")


def refresh(table, targets: DataFrame, dirty: DataFrame, stale: DataFrame, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """(outcomes, dirty, stale) after targets were generated anew, cached or not: those that succeeded are neither dirty nor stale."""
    out = cut(generate_and_cache(table, targets, **options), "refreshed")
    done = out.filter("outcome = 'generated'")
    return out, after_regeneration(dirty, done), after_regeneration(stale, done)


def assign_fn_ids(functions: DataFrame, order: list[str]) -> DataFrame:
    """functions(rel_file, qualified, ...) with fn_id; names that occur more than once in a file are numbered from 0 in the given order."""
    own = Window.partitionBy("rel_file", "qualified")
    n, i = F.count("*").over(own), F.row_number().over(own.orderBy(*order)) - 1
    name = F.concat("qualified", F.when(n > 1, F.concat(F.lit("#"), i.cast("string"))).otherwise(""))
    return functions.withColumn("fn_id", T.fn_id(F.col("rel_file"), name))


def progress(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a pass over outcomes(by, outcome): total, generated, skipped, unresolved, failed, percent (done of all, halves up)."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    done = count("generated", "skipped", "unresolved", "failed")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"), *[count(n).alias(n) for n in ("generated", "skipped", "unresolved", "failed")], F.floor(100.0 * done / F.count("*") + 0.5).alias("percent")
    )


def rolling_eta(completions: DataFrame, key: str, order: list[str], us: Column, remaining: Column, last: int = 5) -> DataFrame:
    """completions with eta_ms: remaining work at the rate of the `last` completions before each; null where no time has passed."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(-last, 0)
    out = completions.withColumn("gl_us", us).withColumn("gl_n", F.count("*").over(own)).withColumn("gl_first", F.min("gl_us").over(own))
    eta = remaining / ((F.col("gl_n") - 1) / ((F.col("gl_us") - F.col("gl_first")) / 1000.0))
    return out.withColumn("eta_ms", F.when((F.col("gl_n") > 1) & (F.col("gl_us") > F.col("gl_first")), eta)).drop("gl_us", "gl_n", "gl_first")


def acceptance_sample(ranked: DataFrame, names: list[str] | None = None, limit: int = 15) -> tuple[DataFrame, DataFrame]:
    """(sample, missing) of ranked(name, pos, ...): the functions of the given names, or else the first `limit` by pos; missing(name): names that none has."""
    spark = ranked.sparkSession
    if not names:
        return ranked.filter(F.col("pos") <= limit), spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return ranked.filter(F.col("name").isin(*names)), missing_names(asked, ranked)


def missing_names(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(name): names asked for that found(name, ...) lacks, each once."""
    return asked.select("name").subtract(found.select("name"))
