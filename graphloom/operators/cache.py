"""Content-addressed result cache as an immutable table: writes return the new state.

Rows: cache_key, fn_id, explanation_json, fn_hash, context_hash, model_id, embedding_model_id, prompt_version,
context_tier, generated_at (text, ordered as such) and seq, which grows with every write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.storage import cut, shuffled

VERSION = ["model_id", "embedding_model_id", "prompt_version"]
TUPLE = ["fn_id", *VERSION]
LOOKUP = ["fn_id", "fn_hash", *VERSION]


def _latest() -> list[Column]:
    return [F.desc("generated_at"), F.desc("seq")]


def newest(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The row of the greatest seq of each key."""
    own = Window.partitionBy(*(key or ["cache_key"])).orderBy(F.desc("seq"))
    return rows.withColumn("k", F.row_number().over(own)).filter("k = 1").drop("k")


def upsert(cache: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Replace by key; of several rows with one key, that of the greatest seq stays. rows carry seqs beyond those of cache."""
    return newest(cache.unionByName(rows.select(*cache.columns)), key)


def numbered(rows: DataFrame, last: int, order: list[str]) -> DataFrame:
    """rows with seqs from last + 1 in the given order. The rows are sorted in ranges, which are counted and numbered each on its own: no task holds all."""
    ranged = cut(rows.orderBy(*order).withColumn("range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("own", own).join(F.broadcast(before), "range").withColumn("seq", F.lit(last) + F.col("before") + F.col("own")).drop("range", "own", "before")


def evicted(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """(cache_key): what rows, one for each tuple, supersede: the key that was current before for the tuple, if it differs. A key that rows hold stays."""
    prior = current_rows(cache.join(shuffled(rows.select(*TUPLE).distinct()), TUPLE, "left_semi")).select(*TUPLE, F.col("cache_key").alias("prior"))
    gone = rows.select(*TUPLE, "cache_key").join(shuffled(prior), TUPLE).filter("prior <> cache_key").select(F.col("prior").alias("cache_key"))
    return gone.join(shuffled(rows.select("cache_key")), "cache_key", "left_anti").distinct()


def evicting_write(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Write rows (one for each tuple), and delete the row that was current before for the tuple, if its key differs."""
    return delete(upsert(cache, rows), evicted(cache, rows))


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(shuffled(keys), "cache_key", "left_anti")


def current_rows(cache: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The current row of each tuple: the latest generated_at, then seq. Superseded rows are what this leaves out."""
    own = Window.partitionBy(*(by or TUPLE)).orderBy(*_latest())
    return cache.withColumn("k", F.row_number().over(own)).filter("k = 1").drop("k")


def current_for_versions(cache: DataFrame, model: str, embedding: str, prompt: str) -> DataFrame:
    """The current row of each function within one tuple of versions."""
    same = (F.col("model_id") == model) & (F.col("embedding_model_id") == embedding) & (F.col("prompt_version") == prompt)
    return current_rows(cache.filter(same), ["fn_id"])


def lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(LOOKUP) with the row that matches all five columns, or nulls; context_hash plays no part."""
    best = cache.groupBy(*LOOKUP).agg(F.max_by(F.struct("cache_key", "explanation_json"), F.struct("generated_at", "seq")).alias("hit"))
    return wanted.join(shuffled(best), LOOKUP, "left").select(*wanted.columns, "hit.cache_key", "hit.explanation_json")


def uncached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(LOOKUP, ...) for which cache has no row."""
    return wanted.join(shuffled(cache.select(*LOOKUP).distinct()), LOOKUP, "left_anti")


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted(LOOKUP, ...) for which cache has a row."""
    return wanted.join(shuffled(cache.select(*LOOKUP).distinct()), LOOKUP, "left_semi")


def purge(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the current rows, one row (purged, left_rows)): superseded rows go."""
    kept = current_rows(cache)
    n = cache.agg(F.count("*").alias("all_rows")).join(kept.agg(F.count("*").alias("left_rows")))  # one row each
    return kept, n.select((F.col("all_rows") - F.col("left_rows")).alias("purged"), "left_rows")


def latest_of(cache: DataFrame, fn_id: str, model: str) -> DataFrame:
    """The current row of one function and model, or none."""
    return cache.filter((F.col("fn_id") == fn_id) & (F.col("model_id") == model)).orderBy(*_latest()).limit(1)


def replace_all(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after all its rows were replaced: fresh alone, in the table's columns. An empty fresh empties it."""
    return fresh.select(*rows.columns)


def enrich(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """nodes(LOOKUP, ...) with cache_key, role_tag and one_liner of the row that matches; nulls where there is none, and for fields that are no strings."""
    hit = lookup(cache, nodes)
    return hit.select(*nodes.columns, "cache_key", T.json_string(F.col("explanation_json"), "role_tag").alias("role_tag"), T.json_string(F.col("explanation_json"), "one_liner").alias("one_liner"))


CLUSTER = "::__cluster_summary__"


def cluster_identity(members: DataFrame, cache: DataFrame) -> DataFrame:
    """(root, fn_id, fn_hash, members, cached, can_synthesize) of each cluster in members(root, root_fn_id, LOOKUP).

    members: the root itself and the nodes of its blast radius. fn_hash covers the cache keys of the members that have
    a row, whatever their order; a cluster can be summed up once it has two of them.
    """
    hit = lookup(cache, members.select("root", "root_fn_id", *LOOKUP).distinct())
    n = F.count_if(F.col("cache_key").isNotNull())
    out = hit.groupBy("root", "root_fn_id").agg(F.count("*").alias("members"), n.alias("cached"), T.set_hash(F.sha2("cache_key", 256)).alias("fn_hash"), (n > 1).alias("can_synthesize"))
    return out.select("root", F.concat("root_fn_id", F.lit(CLUSTER)).alias("fn_id"), "fn_hash", "members", "cached", "can_synthesize")


def changed(cache: DataFrame) -> DataFrame:
    """Rows whose fn_hash differs from the one written before for their tuple; first rows have none before."""
    own = Window.partitionBy(*TUPLE).orderBy("generated_at", "seq")
    return cache.withColumn("prior_hash", F.lag("fn_hash").over(own)).filter("prior_hash <> fn_hash")


def replace_file(rows: DataFrame, fresh: DataFrame, rel_fname: str) -> DataFrame:
    """All rows of one file replaced; an empty fresh deletes them."""
    return rows.filter(F.col("rel_fname") != rel_fname).unionByName(fresh.filter(F.col("rel_fname") == rel_fname))
