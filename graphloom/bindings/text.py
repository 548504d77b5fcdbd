"""Chunking, retrieval and sorted listings over documents, embeddings and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.bindings.tables import read, registry
from graphloom.functions import text as T
from graphloom.operators import vectors as V
from graphloom.operators.graph import positions
from graphloom.plans.digest import write_pages
from graphloom.sources.scan import scan_tree
from graphloom.storage import shared_dir

QUERIES, ORACLE_SQL, query = registry()

_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
CHUNKS = f"""WITH RECURSIVE {_LINES}, s AS (SELECT doc_id, i, length(line) + 1 AS n FROM lines),
f AS (SELECT doc_id, i, i AS start, CASE WHEN n > 500 THEN 0 ELSE 1 END AS held, CASE WHEN n > 500 THEN 0 ELSE n END AS used, n > 500 AS long FROM s WHERE i = 0
UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.n > 500 OR f.held = 0 OR f.held = 12 OR f.used + s.n > 500 THEN s.i ELSE f.start END, CASE WHEN s.n > 500 THEN 0 WHEN f.held = 12 OR f.used + s.n > 500 THEN 1 ELSE f.held + 1 END,
CASE WHEN s.n > 500 THEN 0 WHEN f.held = 12 OR f.used + s.n > 500 THEN s.n ELSE f.used + s.n END, s.n > 500 FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
c AS (SELECT doc_id, start AS start_line, max(i) + 1 AS end_line, string_agg(line, chr(10) ORDER BY i) AS text FROM f JOIN lines USING (doc_id, i) WHERE NOT long GROUP BY doc_id, start
UNION ALL SELECT doc_id, i, i + 1, unnest(list_transform(range(0, length(line), 500), lambda a: substr(line, a + 1, 500))) FROM f JOIN lines USING (doc_id, i) WHERE long)
SELECT doc_id, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, md5(text) AS digest FROM c WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""


def chunks(spark, sf):
    files = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("rel_fname"), F.col("text").alias("content"))
    return V.chunk_files(files)


@query("v1_chunk_text", CHUNKS)
def _v1(spark, sf):
    return chunks(spark, sf).select(F.col("rel_fname").cast("long").alias("doc_id"), "start_line", "end_line", F.md5("text").alias("digest"))


@query("v4_embed_chunks", f"""WITH chunks AS ({CHUNKS.replace("md5(text) AS digest", "text")}), h AS (SELECT doc_id, start_line, end_line, sha256(text) AS h FROM chunks)
SELECT doc_id::VARCHAR AS rel_fname, start_line, end_line, 16::INTEGER AS dims, round(list_sum(list_transform(range(0, 16), lambda i: (('0x' || h[2 * i + 1:2 * i + 2])::INTEGER / 255.0)::FLOAT::DOUBLE)), 4) AS total FROM h""")
def _v4(spark, sf):
    c = V.embed_chunks(chunks(spark, sf))
    return c.select("rel_fname", "start_line", "end_line", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("rel_fname"), F.col("vec_id").alias("start_line"), (F.col("vec_id") + 3).alias("end_line"), F.col("embedding").alias("vector"))


@query("v2_knn_overlap_filtered", """WITH v AS (SELECT 'f' || label AS f, vec_id AS s, vec_id + 3 AS e, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT q.s AS query, q.f AS qf, q.s AS qs, q.e AS qe, v.f, v.s, v.e, round(list_sum(list_transform(list_zip(q.x, v.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM v q, v QUALIFY row_number() OVER (PARTITION BY q.s ORDER BY d, v.f, v.s) <= 20)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY d, f, s)::INTEGER AS rank, f AS rel_fname, s AS start_line, e AS end_line, d AS distance FROM n WHERE NOT (f = qf AND s < qe AND e > qs) QUALIFY rank <= 5""")
def _v2(spark, sf):
    """Every vector asks for its neighbours."""
    v = _vectors(spark, sf)
    return V.nearest(_asked(v), v)


def _asked(v):
    return v.select(F.col("start_line").alias("query"), F.col("rel_fname").alias("q_file"), F.col("start_line").alias("q_start"), F.col("end_line").alias("q_end"), F.col("vector").alias("q_vector"))


QUERIES["t7_overfetch_then_keep"], ORACLE_SQL["t7_overfetch_then_keep"] = QUERIES["v2_knn_overlap_filtered"], ORACLE_SQL["v2_knn_overlap_filtered"]


@query("v3_query_window", "SELECT doc_id, md5(substr(text, 1, 500)) AS digest FROM documents")
def _v3(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(F.substring("text", 1, V.MAX_CHARS)).alias("digest"))


@query("v5_reembed_file", "SELECT 'f' || label AS rel_fname, vec_id, CASE WHEN label = 2 THEN -1 ELSE 1 END AS sign FROM embeddings")
def _v5(spark, sf):
    from graphloom.operators.cache import replace_file

    old = read(spark, sf, "embeddings").select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("rel_fname"), "vec_id", F.lit(1).alias("sign"))
    return replace_file(old, old.withColumn("sign", F.lit(-1)), "f2")


@query("v6_context_tier", "SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN 'call_graph_and_retrieval' ELSE 'call_graph_only' END AS tier FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def _v6(spark, sf):
    """Functions with the chunks that were found for them; no row is a retrieval that failed or found nothing."""
    o = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("retrieved"))
    return read(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", T.context_tier(F.col("retrieved")).alias("tier"))


@query("t9_search_by_label", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey)::INTEGER AS pos FROM part WHERE contains(p_name, 'ring')")
def _t9(spark, sf):
    """Every hit, as a reader would look a label up: by collation, which for these lower-case words is their binary order."""
    hits = read(spark, sf, "part").filter(T.subsequence_match(F.col("p_name"), "ring") == 2).select("p_partkey", "p_name")
    return positions(hits, F.collate("p_name", "UNICODE"), "p_partkey").select("p_partkey", "p_name", "pos")


_DOC_PATH = "coalesce(lang, 'none') || CASE WHEN doc_id % 7 = 0 THEN '/node_modules/' ELSE '/d' END || (doc_id % 10) || '/' || doc_id || '.txt'"


@query("s1_tree_scan", f"SELECT {_DOC_PATH} AS rel_fname, octet_length(encode(coalesce(text, '')))::BIGINT AS length, sha256(coalesce(text, '')) AS sha FROM documents WHERE lang = 'en' AND doc_id % 7 <> 0 AND octet_length(encode(coalesce(text, ''))) < 1500")
def _tree_scan(spark, sf):
    """The documents as files of a tree, some in an excluded folder, of which a scan opens the small ones of one folder alone."""
    folder = f"{shared_dir(spark)}/graphloom/files-{uuid.uuid4().hex}"
    write_pages(read(spark, sf, "documents").select(F.expr(_DOC_PATH).alias("path"), F.coalesce("text", F.lit("")).alias("page")), folder)
    found = scan_tree(spark, folder, "").filter(F.startswith("rel_fname", F.lit("en/")) & (F.col("length") < 1500))
    return found.select("rel_fname", "length", F.sha2("content", 256).alias("sha"))
