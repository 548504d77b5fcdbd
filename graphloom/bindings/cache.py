"""Cache operators over events: a function is a user, a version tuple an event type, a row an event."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.bindings.tables import read, registry
from graphloom.functions import text as T
from graphloom.operators import cache as C
from graphloom.operators.passes import assign_fn_ids, missing_names
from graphloom.sources.tables import CacheTable, VectorTable
from graphloom.storage import shared_dir

QUERIES, ORACLE_SQL, query = registry()


def rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    fn = F.concat(F.lit("fn"), F.col("user_id").cast("string"))
    hashed = F.sha2("props", 256)
    return e.select(
        F.sha2(F.concat(fn, F.lit("|"), "event_type", F.lit("|"), "props"), 256).alias("cache_key"), fn.alias("fn_id"), F.col("props").alias("explanation_json"), hashed.alias("fn_hash"),
        F.lit("ctx").alias("context_hash"), F.col("event_type").alias("model_id"), F.lit("emb").alias("embedding_model_id"), F.lit("v7").alias("prompt_version"),
        F.lit("call_graph_only").alias("context_tier"), F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.col("event_id").alias("seq"),
    )


CACHE = """WITH c AS (SELECT sha256('fn' || user_id || '|' || event_type || '|' || props) AS cache_key, 'fn' || user_id AS fn_id, props AS explanation_json, sha256(props) AS fn_hash,
  event_type AS model_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS generated_at, event_id AS seq FROM events)"""
SMALL = ["cache_key", "fn_id", "model_id", "generated_at", "seq"]
COLS = ", ".join(SMALL)


@query("k1_upsert", f"{CACHE} SELECT {COLS} FROM c QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY seq DESC) = 1")
def _upsert(spark, sf):
    c = rows(spark, sf)
    return C.upsert(c.filter("seq % 2 = 0"), c.filter("seq % 2 = 1")).select(*SMALL)


@query("k1_evicting_write", f"""{CACHE}, old AS (SELECT * FROM c WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY seq DESC) = 1),
w AS (SELECT * FROM c WHERE seq % 3 = 1 QUALIFY row_number() OVER (PARTITION BY fn_id, model_id ORDER BY seq DESC) = 1),
prior AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY fn_id, model_id ORDER BY generated_at DESC, seq DESC) = 1),
gone AS (SELECT p.cache_key FROM prior p JOIN w USING (fn_id, model_id) WHERE p.cache_key <> w.cache_key),
merged AS (SELECT * FROM (FROM old UNION ALL FROM w) QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY seq DESC) = 1)
SELECT {COLS} FROM merged WHERE cache_key NOT IN (SELECT cache_key FROM gone WHERE cache_key NOT IN (SELECT cache_key FROM w))""")
def _evict(spark, sf):
    c = rows(spark, sf)
    old = C.upsert(c.filter("false"), c.filter("seq % 3 = 0"))
    last = Window.partitionBy("fn_id", "model_id").orderBy(F.desc("seq"))
    written = c.filter("seq % 3 = 1").withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")
    # Of one key, the greater seq stays, whichever side wrote it.
    return C.evicting_write(old, written).select(*SMALL)


def _folder(spark):
    return f"{shared_dir(spark)}/graphloom/tables-{uuid.uuid4().hex}"


def chunks(spark, sf):
    """Embeddings as rows of a vector table, the label as the file."""
    e = read(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("rel_fname"), F.col("vec_id").cast("int").alias("start_line"), (F.col("vec_id") + 3).cast("int").alias("end_line"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"))


@query("k2_replace_all", "SELECT 'f' || label AS rel_fname, (vec_id + 5)::INTEGER AS start_line, 'new' || vec_id AS text FROM embeddings")
def _replace_all(spark, sf):
    """A vector table filled, and then filled anew: nothing of the first rows is left."""
    store = VectorTable(spark, _folder(spark))
    store.replace_all(chunks(spark, sf))
    store.replace_all(chunks(spark, sf).withColumn("start_line", F.col("start_line") + 5).withColumn("text", F.replace("text", F.lit("t"), F.lit("new"))))
    return store.read().select("rel_fname", "start_line", "text")


@query("s12_vector_table", "SELECT 'f' || label AS rel_fname, vec_id::INTEGER AS start_line, CASE WHEN label = 3 THEN 'again' ELSE 't' || vec_id END AS text FROM embeddings WHERE label <> 4")
def _vector_table(spark, sf):
    """A vector table opened again after one file was replaced and another one lost all its rows."""
    folder, rows = _folder(spark), chunks(spark, sf)
    store = VectorTable(spark, folder)
    store.replace_all(rows)
    store.replace_file("f3", rows.filter("rel_fname = 'f3'").withColumn("text", F.lit("again")))
    store.replace_file("f4", rows.limit(0))
    return VectorTable(spark, folder).read().select("rel_fname", "start_line", "text")


@query("k3_replace_file", "SELECT 'f' || label AS rel_fname, vec_id FROM embeddings WHERE label <> 3 UNION ALL SELECT 'f3', vec_id + 1000000 FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def _replace_file(spark, sf):
    old = read(spark, sf, "embeddings").select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("rel_fname"), "vec_id")
    fresh = old.filter("vec_id % 2 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return C.replace_file(old, fresh, "f3")


@query("k4_delete_by_key", f"{CACHE} SELECT {COLS} FROM c WHERE cache_key NOT IN (SELECT cache_key FROM c WHERE seq % 5 = 0)")
def _delete(spark, sf):
    c = rows(spark, sf)
    return C.delete(c, c.filter("seq % 5 = 0").select("cache_key").distinct()).select(*SMALL)


CURRENT = f"{CACHE} SELECT {COLS} FROM c QUALIFY row_number() OVER (PARTITION BY fn_id, model_id ORDER BY generated_at DESC, seq DESC) = 1"


@query("w1_current_rows", CURRENT)
def _current(spark, sf):
    return C.current_rows(rows(spark, sf)).select(*SMALL)


@query("k5_purge_superseded", f"{CACHE}, k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY fn_id, model_id ORDER BY generated_at DESC, seq DESC) = 1) SELECT (SELECT count(*) FROM c)::BIGINT - count(*)::BIGINT AS purged, count(*)::BIGINT AS left_rows FROM k")
def _purge(spark, sf):
    return C.purge(rows(spark, sf))[1]


@query("w2_current_for_versions", f"{CACHE} SELECT {COLS} FROM c WHERE model_id = 'view' QUALIFY row_number() OVER (PARTITION BY fn_id ORDER BY generated_at DESC, seq DESC) = 1")
def _versions(spark, sf):
    return C.current_for_versions(rows(spark, sf), "view", "emb", "v7").select(*SMALL)


@query("w3_latest_of_key", f"{CACHE} SELECT {COLS} FROM c WHERE fn_id = 'fn7' AND model_id = 'click' ORDER BY generated_at DESC, seq DESC LIMIT 1")
def _latest(spark, sf):
    return C.latest_of(rows(spark, sf), "fn7", "click").select(*SMALL)


QUERIES["t11_limit_one"], ORACLE_SQL["t11_limit_one"] = QUERIES["w3_latest_of_key"], ORACLE_SQL["w3_latest_of_key"]


@query("s11_cache_open", ORACLE_SQL["k1_upsert"])
def _cache_table(spark, sf):
    """A cache created, written twice, and opened again."""
    folder, c = _folder(spark), rows(spark, sf)
    table = CacheTable(spark, folder)
    table.write(c.filter("seq % 2 = 0"), evict=False)
    table.write(c.filter("seq % 2 = 1"), evict=False)
    return CacheTable(spark, folder).read().select(*SMALL)


@query("k9_write_listeners", "SELECT 1::BIGINT AS writes, count(*)::BIGINT AS written FROM events WHERE event_id % 2 = 0")
def _listeners(spark, sf):
    """What a listener is told of; the second write comes after it has left."""
    table, told = CacheTable(spark, _folder(spark)), []
    leave = table.on_write(lambda r: told.append(r.count()))
    table.write(rows(spark, sf).filter("seq % 2 = 0"), evict=False)
    leave()
    table.write(rows(spark, sf).filter("seq % 2 = 1"), evict=False)
    return spark.createDataFrame([(len(told), sum(told))], "writes long, written long")


@query("w11_changed_hash", f"{CACHE} SELECT {COLS}, prior_hash FROM (SELECT *, lag(fn_hash) OVER (PARTITION BY fn_id, model_id ORDER BY generated_at, seq) AS prior_hash FROM c) WHERE prior_hash <> fn_hash".replace("fn_hash,\n", "fn_hash,\n"))
def _changed(spark, sf):
    return C.changed(rows(spark, sf)).select(*SMALL, "prior_hash")


WANTED = "w AS (SELECT 'fn' || user_id AS fn_id, sha256(props) AS fn_hash, 'view' AS model_id FROM events GROUP BY ALL)"


def _wanted(spark, sf):
    c = rows(spark, sf)
    return c.select("fn_id", "fn_hash", F.lit("view").alias("model_id"), "embedding_model_id", "prompt_version").distinct()


@query("p8_uncached_targets", f"{CACHE}, {WANTED} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.fn_id = w.fn_id AND c.fn_hash = w.fn_hash AND c.model_id = w.model_id)")
def _uncached(spark, sf):
    return C.uncached(_wanted(spark, sf), rows(spark, sf)).select("fn_id", "fn_hash", "model_id")


@query("j8_cached_targets", f"{CACHE}, {WANTED} SELECT * FROM w WHERE EXISTS (SELECT 1 FROM c WHERE c.fn_id = w.fn_id AND c.fn_hash = w.fn_hash AND c.model_id = w.model_id)")
def _cached(spark, sf):
    return C.cached(_wanted(spark, sf), rows(spark, sf)).select("fn_id", "fn_hash", "model_id")


@query("j7_enrich", f"""{CACHE}, {WANTED} SELECT w.fn_id, w.fn_hash, k.cache_key, (k.explanation_json->>'k')::BIGINT AS k FROM w LEFT JOIN
(SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY fn_id, fn_hash, model_id ORDER BY generated_at DESC, seq DESC) = 1) k ON k.fn_id = w.fn_id AND k.fn_hash = w.fn_hash AND k.model_id = w.model_id""")
def _enrich(spark, sf):
    hit = C.lookup(rows(spark, sf), _wanted(spark, sf))
    return hit.select("fn_id", "fn_hash", "cache_key", F.from_json("explanation_json", "k long")["k"].alias("k"))


@query("a13_cluster_members", f"{CACHE}, {WANTED} SELECT fn_id, count(*)::BIGINT AS members, count_if(cached)::BIGINT AS cached, count_if(cached) > 1 AS can_synthesize FROM (SELECT fn_id, EXISTS (SELECT 1 FROM c WHERE c.fn_id = w.fn_id AND c.fn_hash = w.fn_hash AND c.model_id = w.model_id) AS cached FROM w) GROUP BY fn_id")
def _members(spark, sf):
    members = _wanted(spark, sf).withColumn("root", F.col("fn_id")).withColumn("root_fn_id", F.col("fn_id"))
    return C.cluster_identity(members, rows(spark, sf)).select(F.col("root").alias("fn_id"), "members", "cached", "can_synthesize")


@query("a11_set_hash", "SELECT user_id, sha256(string_agg(h, ',' ORDER BY h)) AS set_hash FROM (SELECT user_id, sha256(props) AS h FROM events) GROUP BY user_id")
def _set_hash(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(T.set_hash(F.sha2("props", 256), ",").alias("set_hash"))


QUERIES["t12_sorted_hashes"], ORACLE_SQL["t12_sorted_hashes"] = QUERIES["a11_set_hash"], ORACLE_SQL["a11_set_hash"]


@query("a10_fn_ordinals", "SELECT event_id, 'file' || user_id || '::' || event_type || CASE WHEN count(*) OVER w > 1 THEN '#' || (row_number() OVER (w ORDER BY event_id) - 1) ELSE '' END AS fn_id FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def _ordinals(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("rel_file"), F.col("event_type").alias("qualified"))
    return assign_fn_ids(e, ["event_id"]).select("event_id", "fn_id")


QUERIES["w8_duplicate_ordinals"], ORACLE_SQL["w8_duplicate_ordinals"] = QUERIES["a10_fn_ordinals"], ORACLE_SQL["a10_fn_ordinals"]


@query("u5_missing_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_name FROM part WHERE p_partkey % 7 = 1")
def _missing(spark, sf):
    p = read(spark, sf, "part")
    return missing_names(p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name")), p.filter("p_partkey % 7 = 1").select(F.col("p_name").alias("name")))
