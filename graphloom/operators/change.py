"""Change tracking in batch form: debounce, dirty and stale sets, flush, plans of a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Gaps in one bucket of debounce(): a key's events meet within a bucket, and only its runs beyond.
GAPS = 256


def debounce(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, fired_at_us, triggers): one firing for each run of events of a key that are no more than the gap apart, a gap after the last.

    Events fold into runs within buckets of time first, so that a hot key's events are dealt to many tasks.
    """
    gap = int(gap_seconds * 1e6)
    e = events.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).withColumn("bucket", F.floor(F.col("us") / (gap * GAPS)))
    near = Window.partitionBy(key, "bucket").orderBy("us")
    fresh = lambda since, own: F.coalesce((F.col("us") - F.lag(since).over(own) > gap).cast("int"), F.lit(1))
    e = e.withColumn("fresh", fresh("us", near)).withColumn("run", F.sum("fresh").over(near))
    runs = e.groupBy(key, "bucket", "run").agg(F.min("us").alias("us"), F.max("us").alias("last"), F.count("*").alias("n"))
    own = Window.partitionBy(key).orderBy("us")
    runs = runs.withColumn("fresh", fresh("last", own)).withColumn("whole", F.sum("fresh").over(own))
    return runs.groupBy(key, "whole").agg((F.max("last") + gap).alias("fired_at_us"), F.sum("n").alias("triggers")).drop("whole")


def dirty_functions(changes: DataFrame) -> DataFrame:
    """(file, fn) still dirty after changes(seq, file, fn, kind): 'edit' marks, 'save' clears the file, 'flush' clears the function."""
    saved = changes.filter("kind = 'save'").groupBy("file").agg(F.max("seq").alias("saved"))
    last = changes.filter("kind IN ('edit', 'flush') AND fn IS NOT NULL").groupBy("file", "fn").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    return last.filter("kind = 'edit'").join(saved, "file", "left").filter("saved IS NULL OR seq > saved").select("file", "fn")


def freshness(changes: DataFrame) -> DataFrame:
    """(file, fn, state) after changes(seq, file, fn, kind): 'dirty' before 'stale' before 'fresh'.

    Dirty: the last edit is later than the function's last flush or regeneration and the file's last save. Stale: made
    so after the last regeneration. Only the greatest seq of each kind counts, so rows may come in any order.
    """
    last = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("seq"))), F.lit(-1)).alias(kind)
    saved = changes.filter("kind = 'save'").groupBy("file").agg(F.max("seq").alias("save"))
    own = changes.filter("kind IN ('edit', 'flush', 'regenerate', 'stale') AND fn IS NOT NULL").groupBy("file", "fn").agg(*map(last, ("edit", "flush", "regenerate", "stale")))
    state = F.when(F.col("edit") > F.greatest("flush", "regenerate", F.coalesce("save", F.lit(-1))), "dirty").when(F.col("stale") > F.col("regenerate"), "stale").otherwise("fresh")
    return own.join(saved, "file", "left").select("file", "fn", state.alias("state"))


def flush(dirty: DataFrame, alive: DataFrame, cached: DataFrame, generated: DataFrame) -> DataFrame:
    """dirty(fn) with outcome: 'vanished', 'unchanged' and 'regenerated' clear the mark, 'failed' keeps it."""
    d = dirty.join(alive.select("fn").distinct().withColumn("alive", F.lit(True)), "fn", "left").join(cached.select("fn").distinct().withColumn("hit", F.lit(True)), "fn", "left")
    d = d.join(generated.select("fn").distinct().withColumn("done", F.lit(True)), "fn", "left")
    outcome = F.when(F.col("alive").isNull(), "vanished").when(F.col("hit"), "unchanged").when(F.col("done"), "regenerated").otherwise("failed")
    return d.select(*dirty.columns, outcome.alias("outcome"))


def stale_dependents(changed: DataFrame, context: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(rel_fname, name, line) of the capped callers and callees of changed functions, less those regenerated in the same pass."""
    node = ["rel_fname", "name", "line"]
    near = context.join(changed.select(*node).distinct(), node, "left_semi").select(F.col("r_file").alias("rel_fname"), F.col("r_name").alias("name"), F.col("r_line").alias("line")).distinct()
    return near.join(regenerated.select(*node), node, "left_anti")


def pass_plan(ranked: DataFrame, cached: DataFrame, key: list[str], top_n: int | None) -> DataFrame:
    """What a background pass does with the first top_n of ranked(key, pos): 'skip' the cached, 'generate' the others."""
    scope = ranked if top_n is None else ranked.filter(F.col("pos") <= top_n)
    return scope.join(cached.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("action", F.when(F.col("hit"), "skip").otherwise("generate")).drop("hit")
