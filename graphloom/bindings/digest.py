"""Digest and summary pages over documents as files lang/source/doc_id.txt."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.bindings.tables import read, registry
from graphloom.functions.text import binary_head
from graphloom.plans import digest as D

QUERIES, ORACLE_SQL, query = registry()
MOST, BYTES, CHARS = D.MAX_FILES, D.MAX_BYTES, D.MAX_CHARS


def files(spark, sf):
    d = read(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))).otherwise(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("rel_path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("n_chars").alias("chars"), binary_head(F.encode("text", "UTF-8")).alias("binary"), F.col("text").alias("content"))


FILES = """files AS (SELECT CASE WHEN doc_id % 9 = 0 THEN lang || '/' || doc_id || '.TXT' ELSE lang || '/' || source || '/' || doc_id || '.txt' END AS rel_path, strlen(text)::BIGINT AS size_bytes, n_chars AS chars,
  strlen(text) > 1024 AND hex(encode(text))[2049:2050] BETWEEN '80' AND 'BF' AS bin, text FROM documents)"""
WALK = f"""WITH {FILES}, walk AS (SELECT *, row_number() OVER (ORDER BY list_transform(string_split(rel_path, '/'), lambda x, i: (CASE WHEN i < len(string_split(rel_path, '/')) THEN '1' ELSE '0' END) || x)) - 1 AS place FROM files QUALIFY place < {MOST}),
budget AS (SELECT *, sum(CASE WHEN size_bytes <= {BYTES} AND NOT bin THEN chars ELSE 0 END) OVER (ORDER BY place)::BIGINT AS cum FROM walk),
d AS (SELECT *, CASE WHEN cum > {CHARS} THEN 'budget-exceeded' WHEN size_bytes > {BYTES} THEN 'too-large' WHEN bin THEN 'binary' END AS skip_reason FROM budget)"""


def digested(spark, sf):
    return D.with_budget(D.walk(files(spark, sf)))


@query("s6_walk_files", f"{WALK} SELECT rel_path, place::INTEGER AS place FROM walk")
def _walk(spark, sf):
    return D.walk(files(spark, sf).select("rel_path"))


@query("w7_digest_budget", f"{WALK} SELECT rel_path, place::INTEGER AS place, cum, skip_reason FROM d")
def _budget(spark, sf):
    return digested(spark, sf).select("rel_path", "place", "cum", "skip_reason")


@query("a7_digest_counts", f"{WALK} SELECT count(*)::BIGINT AS total_files, count_if(skip_reason IS NULL)::BIGINT AS included_files, count_if(skip_reason IS NOT NULL)::BIGINT AS skipped_files, count(*) >= {MOST} OR bool_or(cum > {CHARS}) AS truncated FROM d")
def _counts(spark, sf):
    return D.digest_summary(digested(spark, sf))


TREE = f"""{WALK}, n AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i < len(p) AS dir FROM (SELECT string_split(rel_path, '/') AS p, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS i FROM walk)),
m AS (SELECT path, dir, string_split(path, '/')[-1] AS name, array_to_string(string_split(path, '/')[1:-2], '/') AS parent FROM n),
l AS (SELECT *, lead(path) OVER (PARTITION BY parent ORDER BY lower(name), name) IS NULL AS last FROM m),
t AS (SELECT l.path, l.dir, l.name, l.last, string_agg(CASE WHEN u.last THEN '    ' ELSE '│   ' END, '' ORDER BY length(u.path)) FILTER (u.path IS NOT NULL) AS bars FROM l LEFT JOIN l u ON starts_with(l.path, u.path || '/') GROUP BY ALL)"""
LINE = "coalesce(bars, '') || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN dir THEN '/' ELSE '' END"


@query("t10_tree_render", f"{TREE} SELECT path, {LINE} AS line FROM t")
def _tree(spark, sf):
    return D.tree(D.walk(files(spark, sf).select("rel_path")).select("rel_path")).select("path", "line")


@query("k7_digest_text", f"""{TREE}, lines AS (SELECT string_agg({LINE}, chr(10) ORDER BY list_transform(string_split(path, '/'), lambda x: [lower(x), x])) AS tree FROM t),
k AS (SELECT count_if(skip_reason IS NULL) AS inc, count(*) AS total, count_if(skip_reason IS NOT NULL) AS skipped, count(*) >= {MOST} OR bool_or(cum > {CHARS}) AS cut,
string_agg('  - ' || rel_path || ' (' || skip_reason || ', ' || size_bytes || ' bytes)', chr(10) ORDER BY place) FILTER (skip_reason IS NOT NULL) AS s,
string_agg('{"=" * 48}' || chr(10) || 'File: ' || rel_path || chr(10) || '{"=" * 48}' || chr(10) || text || chr(10), chr(10) ORDER BY place) FILTER (skip_reason IS NULL) AS body FROM d)
SELECT md5('Codebase digest: repo' || chr(10) || chr(10) || inc || ' of ' || total || ' file(s) included' || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped' ELSE '' END || '.' || CASE WHEN cut THEN chr(10) || 'NOTE: truncated by a size or count budget.' ELSE '' END
|| chr(10) || chr(10) || 'Directory structure:' || chr(10) || 'repo/' || chr(10) || tree || chr(10) || CASE WHEN s IS NOT NULL THEN chr(10) || 'Skipped files:' || chr(10) || s || chr(10) ELSE '' END || chr(10) || coalesce(body, '')) AS digest FROM k, lines""")
def _text(spark, sf):
    d = digested(spark, sf)
    return D.render("repo", D.digest_summary(d), D.tree(d.select("rel_path")), d).select(F.md5("text").alias("digest"))


PAGES = "SELECT p_partkey, p_brand AS f, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS role, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.' END AS one, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part"


@query("k6_summary_pages", f"""SELECT f AS rel_fname, md5('# ' || f || chr(10) || chr(10) || '## Functions' || chr(10) || chr(10) || string_agg('### ' || p_name || ' (' || coalesce(role, 'Unclassified') || ')' || chr(10) || chr(10) || coalesce(one, '_(no summary cached)_')
|| chr(10) || chr(10) || 'Line ' || (p_partkey + 1) || '.' || chr(10), chr(10) ORDER BY pos)) AS digest FROM ({PAGES}) GROUP BY f""")
def _pages(spark, sf):
    from pyspark.sql import Window

    p = read(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    rows = p.select(F.col("p_brand").alias("rel_fname"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("role_tag"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("."))).alias("one_liner"), F.row_number().over(w).alias("pos"))
    return D.file_page(rows).select("rel_fname", F.md5("page").alias("digest"))


INDEX = "SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_brand, p_name, p_partkey) AS place FROM part"


def _explained(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_brand").alias("rel_fname"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("role_tag"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" | two. Three"))).alias("one_liner"), F.col("p_retailprice").alias("importance"))


def _purposes(spark, sf):
    return read(spark, sf, "part").select(F.col("p_brand").alias("rel_fname")).distinct().withColumn("purpose", F.concat(F.lit("About "), "rel_fname", F.lit("! And more.")))


@query("k6_index_pages", f"""WITH r AS ({INDEX}), f AS (SELECT p_brand, min(place) AS pos FROM r GROUP BY 1)
SELECT 'index.md' AS path, md5('# repo — Codebase Summary' || chr(10) || chr(10) || 'From ' || (SELECT count(*) FROM r) || ' explained function(s) across ' || count(*) || ' file(s).' || chr(10) || chr(10) || '## Files' || chr(10) || chr(10)
  || string_agg('- [' || p_brand || '](' || p_brand || '.md) — About ' || p_brand || '!', chr(10) ORDER BY pos) || chr(10) || chr(10) || '## See also' || chr(10) || chr(10) || '- [Key Functions Index](functions.md)') AS digest FROM f
UNION ALL SELECT 'functions.md', md5('# Key Functions' || chr(10) || chr(10) || 'The ' || count(*) || ' most important function(s), by the call graph.' || chr(10) || chr(10) || '| Function | File | Role | Summary |' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg('| ' || p_name || ' | [' || p_brand || ':' || (p_partkey + 1) || '](' || p_brand || '.md) | ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Unclassified' END || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN p_name || ' \\| two. Three' ELSE '' END || ' |', chr(10) ORDER BY place)) FROM r WHERE place <= 25""")
def _index_pages(spark, sf):
    return D.pages(_explained(spark, sf), _purposes(spark, sf), "repo").filter("path IN ('index.md', 'functions.md')").select("path", F.md5("page").alias("digest"))


@query("a12_functions_by_file", f"SELECT f AS rel_fname, string_agg(p_partkey, ',' ORDER BY pos) AS functions FROM ({PAGES}) GROUP BY f")
def _by_file(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = read(spark, sf, "part").select(F.col("p_brand").alias("rel_fname"), "p_partkey", F.row_number().over(w).alias("pos"))
    return D.functions_by_file(ranked, F.col("p_partkey").cast("string")).select("rel_fname", F.array_join("functions", ",").alias("functions"))
