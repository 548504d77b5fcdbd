"""Change tracking over events: a file is a user, a function a user and parity, kinds are event types."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.bindings import cache as BC
from graphloom.bindings import graph as BG
from graphloom.bindings.tables import read, registry
from graphloom.functions import text as T
from graphloom.operators import cache as CC
from graphloom.operators import change as C
from graphloom.operators import factored as X
from graphloom.operators import merkle, passes
from graphloom.storage import shared_dir
from graphloom.streaming import freshness

QUERIES, ORACLE_SQL, query = registry()
GAP_HOURS = 2

ORACLE_DEBOUNCE = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, coalesce((us - lag(us) OVER w > {GAP_HOURS * 3600 * 1000000})::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, max(us)::BIGINT + {GAP_HOURS * 3600 * 1000000} AS fired_at_us, count(*)::BIGINT AS triggers FROM r GROUP BY user_id, run"""


@query("r1_debounce", ORACLE_DEBOUNCE)
def _debounce(spark, sf):
    return C.debounce(read(spark, sf, "events"), "user_id", "ts", GAP_HOURS * 3600)


def changes(spark, sf):
    e = read(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "error", "flush")
    fn = F.concat(F.lit("fn"), (F.col("event_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("file"), fn.alias("fn"), kind.alias("kind")).filter("kind IS NOT NULL")


CHANGES = "WITH c AS (SELECT event_id AS seq, user_id AS file, 'fn' || (event_id % 7) AS fn, CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'flush' END AS kind FROM events WHERE event_type IN ('click', 'purchase', 'error'))"
DIRTY = f"""{CHANGES}, d AS (SELECT file, fn FROM c e WHERE kind = 'edit' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.file = e.file AND x.seq > e.seq AND (x.kind = 'save' OR x.fn = e.fn AND x.kind IN ('edit', 'flush'))))"""


@query("r3_dirty_set", f"{DIRTY} SELECT file, fn FROM d")
def _dirty(spark, sf):
    return C.dirty_functions(changes(spark, sf))


@query("r4_flush", f"{DIRTY} SELECT file, fn, CASE WHEN fn = 'fn0' THEN 'vanished' WHEN fn IN ('fn1', 'fn2') THEN 'unchanged' WHEN fn IN ('fn3', 'fn4') THEN 'regenerated' ELSE 'failed' END AS outcome FROM d")
def _flush(spark, sf):
    names = lambda *n: spark.sql("SELECT * FROM VALUES " + ", ".join(f"('fn{i}')" for i in n) + " AS t(fn)")
    return C.flush(C.dirty_functions(changes(spark, sf)), names(1, 2, 3, 4, 5, 6), names(1, 2), names(3, 4))


@query("u7_dirty_minus_flushed", f"{DIRTY} SELECT file, fn FROM d WHERE fn IN ('fn5', 'fn6')")
def _left(spark, sf):
    names = lambda *n: spark.sql("SELECT * FROM VALUES " + ", ".join(f"('fn{i}')" for i in n) + " AS t(fn)")
    return C.flush(C.dirty_functions(changes(spark, sf)), names(1, 2, 3, 4, 5, 6), names(1, 2), names(3, 4)).filter("outcome = 'failed'").select("file", "fn")


STALE = f"""{BG.CONTEXT}, near AS (SELECT DISTINCT r FROM ctx)
SELECT file AS rel_fname, name, r AS line FROM near JOIN parts ON p_partkey = r WHERE r % 5 <> 0"""


@query("r5_stale_propagation", "WITH " + STALE)
def _stale(spark, sf):
    regenerated = BG.parts(spark, sf).filter("p_partkey % 5 = 0").select(F.col("file").alias("rel_fname"), "name", F.col("p_partkey").alias("line"))
    return C.stale_dependents(BG.roots(spark, sf).drop("root"), X.function_context(BG.walks(spark, sf)), regenerated)


for _name in ("j10_stale_dependents", "u3_callers_union_callees"):
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES["r5_stale_propagation"], ORACLE_SQL["r5_stale_propagation"]


@query("r7_background_pass", f"WITH {BG.RANKED}, t AS (SELECT k, row_number() OVER (ORDER BY importance DESC, file, name, k) AS pos FROM imp QUALIFY pos <= 200) SELECT k AS line, pos::INTEGER AS pos, CASE WHEN k % 3 = 0 THEN 'skip' ELSE 'generate' END AS action FROM t")
def _pass(spark, sf):
    ranked = BG._top(spark, sf, 200).select("line", "pos")
    cached = BG.parts(spark, sf).filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("line"))
    return C.pass_plan(ranked, cached, ["line"], 200)


@query("r2_save_reindex", """WITH c AS (SELECT 'fn' || user_id AS fn_id, event_type AS model_id, sha256(props) AS fn_hash, event_id AS seq, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS generated_at FROM events),
f AS (SELECT DISTINCT fn_id, model_id, CASE WHEN seq % 3 = 0 THEN fn_hash ELSE sha256(fn_hash) END AS fn_hash FROM c),
prior AS (SELECT fn_id, model_id, fn_hash AS prior_hash FROM c WHERE model_id <> 'signup' QUALIFY row_number() OVER (PARTITION BY fn_id, model_id ORDER BY generated_at DESC, seq DESC) = 1),
o AS (SELECT f.*, prior_hash, CASE WHEN f.model_id <> 'signup' AND EXISTS (SELECT 1 FROM c WHERE c.fn_id = f.fn_id AND c.fn_hash = f.fn_hash AND c.model_id = f.model_id) THEN 'skipped' WHEN f.fn_id LIKE '%3' THEN 'failed' ELSE 'regenerated' END AS outcome
  FROM f LEFT JOIN prior USING (fn_id, model_id))
SELECT fn_id, model_id, fn_hash, outcome, outcome = 'regenerated' AND coalesce(prior_hash <> fn_hash, false) AS changed FROM o""")
def _saves(spark, sf):
    """Functions as saved: some unchanged, some edited, some whose kind was never cached, and some that a model fails on."""
    rows = BC.rows(spark, sf)
    now = rows.select("fn_id", F.when(F.col("seq") % 3 == 0, F.col("fn_hash")).otherwise(F.sha2("fn_hash", 256)).alias("fn_hash"), *CC.VERSION).distinct()
    done = now.select("fn_id").filter("fn_id NOT LIKE '%3'")
    return passes.save_outcomes(now, rows.filter("model_id <> 'signup'"), done).select("fn_id", "model_id", "fn_hash", "outcome", "changed")


@query("r2_save_runs", f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), f AS (SELECT *, coalesce((us - lag(us) OVER w > {GAP_HOURS * 3600 * 1000000})::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id AS file, sum(fresh)::BIGINT AS runs, count(*)::BIGINT AS saves FROM f GROUP BY user_id""")
def _runs(spark, sf):
    runs = C.debounce(read(spark, sf, "events").filter("event_type = 'purchase'"), "user_id", "ts", GAP_HOURS * 3600)
    return runs.groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("runs"), F.sum("triggers").alias("saves"))


@query("r11_back_target", "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 15000000, false) AS live FROM events")
def _back(spark, sf):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf, "events").select("event_id", T.back_target_live(F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), us).alias("live"))


def freshness_events(spark, sf):
    e = read(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "error", "flush").when(F.col("event_type") == "signup", "regenerate").otherwise("stale")
    return e.select(F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("file"), F.concat(F.lit("fn"), (F.col("event_id") % 7).cast("string")).alias("fn"), kind.alias("kind"))


FRESHNESS = """WITH c AS (SELECT event_id AS seq, user_id::VARCHAR AS file, 'fn' || (event_id % 7) AS fn, CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'flush' WHEN 'signup' THEN 'regenerate' ELSE 'stale' END AS kind FROM events),
s AS (SELECT file, max(seq) AS save FROM c WHERE kind = 'save' GROUP BY file),
m AS (SELECT file, fn, coalesce(max(seq) FILTER (kind = 'edit'), -1) AS edit, coalesce(max(seq) FILTER (kind = 'flush'), -1) AS flush, coalesce(max(seq) FILTER (kind = 'regenerate'), -1) AS made, coalesce(max(seq) FILTER (kind = 'stale'), -1) AS stale FROM c WHERE kind <> 'save' GROUP BY file, fn)
SELECT file, fn, CASE WHEN edit > greatest(flush, made, coalesce(save, -1)) THEN 'dirty' WHEN stale > made THEN 'stale' ELSE 'fresh' END AS state FROM m LEFT JOIN s USING (file)"""


@query("r5_freshness", FRESHNESS)
def _freshness(spark, sf):
    return C.freshness(freshness_events(spark, sf))


@query("r4_freshness_stream", FRESHNESS)
def _freshness_stream(spark, sf):
    """The same states by the state machine over a stream of the events in the order of a hash, in several batches."""
    folder = f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    rows = freshness_events(spark, sf)
    rows.repartition(3, F.xxhash64("seq")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = freshness.freshness_stream(stream, GAP_HOURS * 3600, 3600, "3650 days")
    write = lambda batch, i: batch.withColumn("gl_batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/n={i}")
    with freshness.state_store(spark):
        q = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return freshness.last_states(spark.read.parquet(f"{folder}/out"))


_PATH = "coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id % 50) || '/' || doc_id || '.txt'"


@query("s13_tree_changes", f"""SELECT {_PATH} AS rel_fname, CASE WHEN doc_id % 19 = 0 THEN 'added' WHEN doc_id % 17 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 19 = 0) <> (doc_id % 17 = 0) OR doc_id % 13 = 0 AND doc_id % 19 <> 0 AND doc_id % 17 <> 0""")
def _tree_changes(spark, sf):
    """The documents as the files of a tree in two states, compared by the digests of folders."""
    folder = f"{shared_dir(spark)}/graphloom/trees-{uuid.uuid4().hex}"
    files = read(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("rel_fname"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    old = merkle.TreeState(spark, f"{folder}/old").write(files.filter("doc_id % 19 <> 0"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("digest", F.lit("+"))).otherwise(F.col("digest"))
    new = merkle.TreeState(spark, f"{folder}/new").write(files.filter("doc_id % 17 <> 0").withColumn("digest", edited))
    return merkle.changed_files(old, new)[0]
