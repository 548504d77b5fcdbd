"""Call graph: resolution of references, confidence, incremental update, rank and graph queries.

Relations (columns): tags(rel_fname, name, kind, start_line, end_line, start_byte, end_byte, tag_seq),
aliases(rel_fname, name, target_name), edges(caller_file, caller_name, caller_line, callee_file, callee_name,
callee_line, weight, confident), importance(rel_fname, name, line, importance). One total order holds everywhere:
importance falling, then file, name, line.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.storage import cut, discard

CALLER, CALLEE = ["caller_file", "caller_name", "caller_line"], ["callee_file", "callee_name", "callee_line"]
NODE = ["rel_fname", "name", "line"]
RELATED_CAP, LEVEL_CAP, DEPTH = 15, 15, 3
#: Edges of an update up to which they are told apart from the others (six short columns each).
BROADCAST_EDGES = 100_000
#: Bytes of a file in one bucket of the containment join.
SPAN_BUCKET = 4096


def nodes(tags: DataFrame) -> DataFrame:
    """Distinct definitions as graph nodes."""
    return tags.filter("kind = 'def'").select("rel_fname", "name", F.col("start_line").alias("line")).distinct()


def alias_targets(aliases: DataFrame) -> DataFrame:
    """Distinct (name, target_name), whichever files say so."""
    return aliases.select("name", "target_name").distinct()


def dyadic(first: Column, last: Column) -> Column:
    """array<struct<level, node>>: the whole numbers from first (0 or more) to last as at most two aligned ranges [node * 2**level, (node + 1) * 2**level) of each level.

    A number lies in at most one of them, the one of its own node at that level.
    """
    end = last + 1
    levels = F.sequence(F.lit(0), F.ceil(F.log2((end - first).cast("double"))).cast("int") + 1)
    right = lambda x, k: F.call_function("shiftright", x, k)

    def ends(k: Column) -> Column:
        low, high = right(first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), right(end, k)
        part = lambda odd, node: F.when((low < high) & (odd.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(k.alias("level"), node.alias("node")))
        return F.array(part(low, low), part(high, high - 1))

    return F.when(first <= last, F.array_compact(F.flatten(F.transform(levels, ends))))


def _stabbed(points: DataFrame, spans: DataFrame, key: str, at: str, span: tuple[str, str], bucket: int, span_key: str | None = None) -> DataFrame:
    """points with each span (found) of equal key that touches the bucket of `at`.

    A span is listed under a few dyadic ranges of buckets, however long it is; a point under its own node at each level
    that spans of its key have. So both grow with the logarithm of the longest span, and only keys that hold long spans
    have many levels.
    """
    fields = [F.col(c).alias(c) for c in spans.columns]
    place = lambda c: F.floor(c / bucket).cast("long")
    listed = spans.select(F.struct(*fields).alias("found"), F.col(span_key or key).alias("s_key"), F.inline(dyadic(place(F.col(span[0])), place(F.col(span[1]))))).withColumnsRenamed({"level": "s_level", "node": "s_node"})
    levels = listed.groupBy("s_key").agg(F.collect_set("s_level").alias("levels"))  # at most 64
    near = points.join(levels, F.col(key) == F.col("s_key")).select(*points.columns, F.explode("levels").alias("p_level"))
    near = near.withColumn("p_node", F.call_function("shiftright", place(F.col(at)), F.col("p_level")))
    return near.join(listed, (F.col(key) == F.col("s_key")) & (F.col("p_level") == F.col("s_level")) & (F.col("p_node") == F.col("s_node")))


def innermost(points: DataFrame, spans: DataFrame, key: str, at: tuple[str, str], span: tuple[str, str], seq: str, bucket: int) -> DataFrame:
    """points with the struct `found`: the narrowest span of equal key that holds [at[0], at[1]], the least seq on ties; points within none are dropped.

    An equi-join on key and dyadic ranges of buckets; see _stabbed. points must be distinct rows, places 0 or more.
    """
    inside = (F.col("found")[span[0]] <= F.col(at[0])) & (F.col(at[1]) <= F.col("found")[span[1]])
    met = _stabbed(points, spans, key, at[0], span, bucket).filter(inside)
    width = F.struct((F.col("found")[span[1]] - F.col("found")[span[0]]).alias("w"), F.col("found")[seq].alias("q"))
    return met.groupBy(*points.columns).agg(F.min_by("found", width).alias("found"))


def slim(tags: DataFrame) -> DataFrame:
    """tags less what no operator on references reads: their lines and numbers. A table of them to be written takes half the space."""
    own = lambda c: F.when(F.col("kind") == "def", F.col(c)).alias(c)
    return tags.select("rel_fname", "name", "kind", own("start_line"), "start_byte", "end_byte", own("tag_seq"))


def enclosed_refs(tags: DataFrame, whole: bool = True) -> DataFrame:
    """(caller node, name, refs): references counted by their innermost definition and their name.

    whole=False: counted where they are placed, so that a caller and name have a row in each bucket that holds such
    references; they are not shuffled again, and what adds refs up gets the same of both.

    Buckets of a file that hold references meet the definitions that touch them, and a reference then finds its own in its
    bucket's list, narrowest first: references are shuffled once to be placed and, if whole, once to be counted. A list has one entry
    for each span, so it is as long as the spans that touch SPAN_BUCKET bytes. tags are read twice; a written table is best.
    """
    refs = tags.filter("kind = 'ref'").select("rel_fname", "name", "start_byte", "end_byte", (F.floor(F.col("start_byte") / SPAN_BUCKET) * SPAN_BUCKET).alias("bucket"))
    spans = tags.filter("kind = 'def'").groupBy("rel_fname", F.col("start_byte").alias("s"), F.col("end_byte").alias("e")).agg(F.min(F.struct("tag_seq", F.col("name").alias("def_name"), "start_line")).alias("first"))
    met = _stabbed(refs.select(F.col("rel_fname").alias("b_file"), "bucket").distinct(), spans, "b_file", "bucket", ("s", "e"), SPAN_BUCKET, "rel_fname")
    span = F.struct((F.col("found.e") - F.col("found.s")).alias("width"), F.col("found.first").alias("first"), F.col("found.s").alias("s"), F.col("found.e").alias("e"))
    listed = met.groupBy(F.col("b_file").alias("rel_fname"), "bucket").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    inside = F.filter("spans", lambda x: (x["s"] <= F.col("start_byte")) & (F.col("end_byte") <= x["e"]))
    found = refs.join(listed, ["rel_fname", "bucket"]).select("rel_fname", "bucket", "name", F.inline(F.slice(inside, 1, 1)))
    where = [] if whole else ["bucket"]  # as they lie after the join
    found = found.groupBy("rel_fname", *where, F.col("first.def_name").alias("caller_name"), F.col("first.start_line").alias("caller_line"), "name").agg(F.count("*").alias("refs"))
    return found.select(F.col("rel_fname").alias("caller_file"), "caller_name", "caller_line", "name", "refs")


def candidates(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, callee node, tags, total): what a name may refer to. Definitions count by tag, those through aliases once."""
    defs = tags.filter("kind = 'def'").select("name", F.col("rel_fname").alias("callee_file"), F.col("name").alias("callee_name"), F.col("start_line").alias("callee_line"), "start_byte", "end_byte", "tag_seq")
    via = alias_targets(aliases).withColumnRenamed("name", "alias").join(defs, F.col("target_name") == F.col("name")).filter("alias <> name")
    both = defs.unionByName(via.drop("name", "target_name").withColumnRenamed("alias", "name").distinct())
    by_node = both.groupBy("name", *CALLEE).agg(F.count("*").alias("tags"))
    return by_node.withColumn("total", F.sum("tags").over(Window.partitionBy("name")))


def contributions(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(caller, name, callee, weight, confident): what the references of a caller to a name add to each edge; refs of enclosed_refs(), found of candidates()."""
    sure = (F.col("total") == 1) | (F.col("callee_file") == F.col("caller_file"))
    return refs.join(found, "name").select(*CALLER, "name", *CALLEE, (F.col("refs") * F.col("tags")).alias("weight"), sure.alias("confident"))


def fold(parts: DataFrame) -> DataFrame:
    """Edges of contributions: weights added up, confident where some reference is."""
    return parts.groupBy(*CALLER, *CALLEE).agg(F.sum("weight").alias("weight"), F.bool_or("confident").alias("confident"))


def call_graph(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with weight (references times matching tags) and confident (some reference is unambiguous or stays in its file).

    References fold by caller and name before they meet candidates, so the many-to-many join carries one row for each
    caller, name and candidate node.
    """
    return fold(contributions(enclosed_refs(tags), candidates(tags, aliases)))


def _in(column: str, files: str | list[str]) -> Column:
    """Whether a column names one of the files (a commit's or a save's: a short list)."""
    return F.col(column).isin(*([files] if isinstance(files, str) else files))


def affected_names(old_tags: DataFrame, new_tags: DataFrame, aliases: DataFrame, files: str | list[str]) -> DataFrame:
    """(name): what the files define or defined, and the aliases of it."""
    touched = old_tags.filter(_in("rel_fname", files)).unionByName(new_tags.filter(_in("rel_fname", files))).filter("kind = 'def'").select("name").distinct()
    spelled = alias_targets(aliases).join(touched.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select("name")
    return touched.union(spelled).distinct()


def update_contributions(parts: DataFrame, old_tags: DataFrame, new_tags: DataFrame, aliases: DataFrame, files: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, fresh): contributions after the tags of one file or some have changed; together they equal those of new_tags.

    Only the files' own references and those to affected names are resolved again: they are picked before the
    containment join, and meet only the definitions of their names. aliases must be those of both states; where they
    changed, build anew.
    """
    names = cut(affected_names(old_tags, new_tags, aliases, files), "affected-names")
    own, refs, defs = _in("rel_fname", files), new_tags.filter("kind = 'ref'"), new_tags.filter("kind = 'def'")
    picked = refs.filter(own).unionByName(refs.filter(~own).join(names, "name", "left_semi"))
    fresh = cut(enclosed_refs(picked.unionByName(defs)), "fresh-refs")
    wanted = fresh.select("name").distinct()
    spelled = alias_targets(aliases).join(wanted, "name", "left_semi")
    reached = wanted.union(spelled.select(F.col("target_name").alias("name"))).distinct()
    found = candidates(defs.join(reached, "name", "left_semi"), spelled).join(wanted, "name", "left_semi")
    kept = parts.filter(~_in("caller_file", files)).join(names, "name", "left_anti")
    return kept, contributions(fresh, found)


def update_call_graph(edges: DataFrame, parts: DataFrame, old_tags: DataFrame, new_tags: DataFrame, aliases: DataFrame, files: str | list[str]) -> DataFrame:
    """Edges after the tags of one file or some have changed, equal to call_graph(new_tags, aliases); edges is the fold of parts."""
    kept, fresh = update_contributions(parts, old_tags, new_tags, aliases, files)
    return refold(edges, parts, kept, cut(fresh, "fresh-parts"), affected_names(old_tags, new_tags, aliases, files), files)


def refold(edges: DataFrame, parts: DataFrame, kept: DataFrame, fresh: DataFrame, names: DataFrame, files: str | list[str]) -> DataFrame:
    """Edges of kept and fresh, contributions of update_contributions(), of which fresh is a written table.

    Only the edges that lose or gain a contribution are folded again; the others are passed on where they lie. Where
    that is more than BROADCAST_EDGES of them, one fold of all costs less than telling them apart.
    """
    if fresh.count() > BROADCAST_EDGES:
        return fold(kept.unionByName(fresh))
    lost = parts.filter(_in("caller_file", files)).select(*CALLER, *CALLEE).union(parts.filter(~_in("caller_file", files)).join(names, "name", "left_semi").select(*CALLER, *CALLEE))
    touched = cut(lost.union(fresh.select(*CALLER, *CALLEE)).distinct(), "touched-edges")
    again = fold(kept.join(touched, CALLER + CALLEE, "left_semi").unionByName(fresh))
    return edges.join(touched, CALLER + CALLEE, "left_anti").unionByName(again.select(*edges.columns))


def reindex(parts: DataFrame, edges: DataFrame, old_tags: DataFrame, new_tags: DataFrame, old_aliases: DataFrame, new_aliases: DataFrame, files: str | list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(contributions of new_tags, their edges, the files' number of definitions) after files were read anew; where aliases changed, all is resolved again."""
    old, new = alias_targets(old_aliases), alias_targets(new_aliases)
    same = not old.exceptAll(new).unionByName(new.exceptAll(old)).head(1)
    if same:
        kept, fresh = update_contributions(parts, old_tags, new_tags, new_aliases, files)
        fresh = cut(fresh, "fresh-parts")
        out = cut(kept.unionByName(fresh), "parts")
        edges = refold(edges, parts, kept, fresh, affected_names(old_tags, new_tags, new_aliases, files), files)
    else:
        out = cut(contributions(enclosed_refs(new_tags), candidates(new_tags, new_aliases)), "parts")
        edges = fold(out)
    return out, edges, new_tags.filter(_in("rel_fname", files) & (F.col("kind") == "def")).count()


def pagerank(node_table: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, start: DataFrame | None = None) -> DataFrame:
    """importance of each node: weighted PageRank; uniform if it has not settled after all iterations.

    tolerance None runs exactly the given iterations. Dangling mass spreads evenly. Nodes are numbered once. The links
    stay dealt by caller over all steps; a step shuffles (node, rank) and the sums by callee. start: an importance of
    before, from which an update settles in few steps; nodes that it lacks start at their even share. A run that has
    settled is no further than damping / (1 - damping) * nodes * tolerance (all nodes together) from the exact rank,
    wherever it started.
    """
    out = edges.groupBy(*CALLER).agg(F.sum("weight").alias("total")).select(*[F.col(c).alias(k) for c, k in zip(CALLER, NODE, strict=True)], "total")
    named = cut(node_table.join(out, NODE, "left").select(*NODE, "total", F.monotonically_increasing_id().alias("id")), "rank-nodes")
    shares = edges.join(_end(named, CALLER, "src").join(named.select(F.col("id").alias("src"), "total"), "src"), CALLER).join(_end(named, CALLEE, "dst"), CALLEE)
    links = cut(shares.select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-links").repartition("src").persist()
    spread = lambda x: links.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("got"))
    try:
        return _settle(node_table, named, spread, damping, iterations, tolerance, start)
    finally:
        links.unpersist()


def _end(named: DataFrame, side: list[str], to: str) -> DataFrame:
    return named.select(*[F.col(k).alias(c) for k, c in zip(NODE, side, strict=True)], F.col("id").alias(to))


def _settle(node_table: DataFrame, named: DataFrame, spread: Callable[[DataFrame], DataFrame], damping: float, iterations: int, tolerance: float | None, start: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """importance by power iteration over named(NODE, total, id), total null for dangling nodes; spread(x(id, x)) gives (id, got). kinds(id, dangling, many): where an id stands for many nodes of one rank.

    A step ends in a written table of numbers, whose write also brings back the dangling mass and the change.
    """
    n = named.count()
    if not n:
        return node_table.withColumn("importance", F.lit(0.0))
    many = F.lit(1) if kinds is None else F.col("many")
    x = (named.select("id", F.col("total").isNull().alias("dangling")) if kinds is None else kinds.select("id", "dangling", "many")).withColumn("x", F.lit(1.0 / n))
    if start is not None:
        known = cut(named.join(start.select(*NODE, "importance"), NODE, "left").select("id", F.col("total").isNull().alias("dangling"), F.coalesce("importance", F.lit(1.0 / n)).alias("x")), "rank-start", "snappy")
        whole = known.agg(F.sum("x")).first()[0]
        x = known.withColumn("x", F.col("x") / whole) if whole else x
    loose = x.agg(F.sum(F.when(F.col("dangling"), F.col("x") * many))).first()[0] or 0.0
    settled, written = tolerance is None, []
    for _ in range(iterations):
        fresh = damping * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - damping) / n  # loose: the dangling nodes' share
        seen = Observation()
        step = x.withColumnRenamed("x", "old").join(spread(x), "id", "left").select("id", "dangling", *([] if kinds is None else ["many"]), fresh.alias("x"), "old")
        step = step.observe(seen, F.sum(F.when(F.col("dangling"), F.col("x") * many)).alias("loose"), F.sum(F.abs(F.col("x") - F.col("old")) * many).alias("moved"))
        before, written = written, [cut(step, "rank-x", "snappy")]
        x = written[0].drop("old")
        discard(*before)
        loose = seen.get["loose"] or 0.0
        if tolerance is not None and seen.get["moved"] < n * tolerance:
            settled = True
            break
    if not settled:
        return node_table.withColumn("importance", F.lit(1.0 / n))
    return named.join(x, "id").select(*NODE, F.col("x").alias("importance"))


def confident_edges(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(caller, callee) of the confident edges of enclosed_refs() and candidates(), each once: names of one tag, and candidates in the caller's own file. No other pair is made."""
    one = refs.join(found.filter("total = 1"), "name").select(*CALLER, *CALLEE)
    own = found.filter("total > 1").withColumnRenamed("name", "c_name")
    near = refs.join(own, (F.col("name") == F.col("c_name")) & (F.col("caller_file") == F.col("callee_file"))).select(*CALLER, *CALLEE)
    return one.unionByName(near).distinct()


def fan_in_by_names(node_table: DataFrame, refs: DataFrame, found: DataFrame) -> DataFrame:
    """fan_in() of call_graph()'s edges without making them: references fold by name, then meet the name's candidates."""
    asked = refs.groupBy("name").agg(F.sum("refs").alias("refs"))
    got = found.join(asked, "name").groupBy(*CALLEE).agg(F.sum(F.col("refs") * F.col("tags")).alias("w"))
    return node_table.join(got.select(*[F.col(c).alias(k) for c, k in zip(CALLEE, NODE, strict=True)], "w"), NODE, "left").select(*NODE, F.coalesce("w", F.lit(0)).cast("double").alias("importance"))


def pagerank_by_names(node_table: DataFrame, refs: DataFrame, found: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """pagerank() of call_graph()'s edges without making them: a step goes from callers to names, and from names to their candidates.

    refs: enclosed_refs(), found: candidates(). References times candidates of a hot name are never paired, so all
    tables are linear in the tags. Nodes that get the same from the same names always have one rank, and a step runs over
    such kinds of nodes.
    """
    names = cut(found.select("name", "total").distinct().withColumn("no", F.monotonically_increasing_id()), "rank-names")
    asked = refs.join(names, "name").select(*CALLER, "no", "refs", (F.col("refs") * F.col("total")).alias("weight"))
    out = asked.groupBy(*CALLER).agg(F.sum("weight").alias("total")).select(*[F.col(c).alias(k) for c, k in zip(CALLER, NODE, strict=True)], "total")
    got = found.join(names.select("name", "no"), "name").groupBy(*[F.col(c).alias(k) for c, k in zip(CALLEE, NODE, strict=True)]).agg(F.array_sort(F.collect_list(F.struct("no", "tags"))).alias("gets"))
    each = node_table.join(out, NODE, "left").join(got, NODE, "left").withColumn("dangling", F.col("total").isNull())
    each = cut(each.withColumn("gets", F.coalesce("gets", F.array().cast(got.schema["gets"].dataType))), "rank-nodes")
    kinds = cut(each.groupBy("gets", "dangling").agg(F.count("*").alias("many")).withColumn("id", F.monotonically_increasing_id()), "rank-kinds")
    named = cut(each.join(kinds.drop("many"), ["gets", "dangling"]).select(*NODE, "total", "id"), "rank-ids")
    # A caller's share of a name is spread over the name's tags: refs * total / (out * total) for each, so by refs / out a tag.
    ends = named.select(*[F.col(k).alias(c) for k, c in zip(NODE, CALLER, strict=True)], F.col("id").alias("src"), F.col("total").alias("out"))
    first = asked.join(ends, CALLER).groupBy("src", "no").agg(F.sum(F.col("refs") / F.col("out")).alias("share"))
    second = kinds.select(F.col("id").alias("dst"), F.inline("gets")).select("no", "dst", "tags")
    first, second = cut(first, "rank-callers").repartition("src").persist(), cut(second, "rank-candidates").repartition("no").persist()

    def spread(x: DataFrame) -> DataFrame:
        sent = first.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy("no").agg(F.sum(F.col("x") * F.col("share")).alias("y"))
        return second.join(sent, "no").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("y") * F.col("tags")).alias("got"))

    try:
        return _settle(node_table, named, spread, damping, iterations, tolerance, kinds=kinds)
    finally:
        first.unpersist()
        second.unpersist()


def fan_in(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """importance as the weight of all references to a node: exact in any engine."""
    got = edges.groupBy(*[F.col(c).alias(k) for c, k in zip(CALLEE, NODE, strict=True)]).agg(F.sum("weight").alias("w"))
    return node_table.join(got, NODE, "left").select(*NODE, F.coalesce("w", F.lit(0)).cast("double").alias("importance"))


def _by(prefix: str) -> list[Column]:
    return [F.desc("importance"), F.col(f"{prefix}file"), F.col(f"{prefix}name"), F.col(f"{prefix}line")]


def _ranked(df: DataFrame, importance: DataFrame, cols: list[str]) -> DataFrame:
    named = importance.select(*[F.col(k).alias(c) for c, k in zip(cols, NODE, strict=True)], "importance")
    return df.join(named, cols, "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def function_context(edges: DataFrame, importance: DataFrame, cap: int = RELATED_CAP) -> DataFrame:
    """For every function and direction ('caller', 'callee'), the first cap confident neighbours with pos (from 1) and omitted.

    Columns: rel_fname, name, line, direction, pos, r_file, r_name, r_line, importance, omitted.
    """
    sure = edges.filter("confident")
    up = sure.select(*[F.col(c).alias(k) for c, k in zip(CALLEE, NODE, strict=True)], F.lit("caller").alias("direction"), *[F.col(c).alias(k) for c, k in zip(CALLER, ["r_file", "r_name", "r_line"], strict=True)])
    down = sure.select(*[F.col(c).alias(k) for c, k in zip(CALLER, NODE, strict=True)], F.lit("callee").alias("direction"), *[F.col(c).alias(k) for c, k in zip(CALLEE, ["r_file", "r_name", "r_line"], strict=True)])
    both = _ranked(up.unionByName(down), importance, ["r_file", "r_name", "r_line"])
    own = Window.partitionBy(*NODE, "direction")
    both = both.withColumn("omitted", F.greatest(F.count("*").over(own) - cap, F.lit(0))).withColumn("pos", F.row_number().over(own.orderBy(*_by("r_"))))
    return both.filter(F.col("pos") <= cap)


def _numbered(edges: DataFrame, importance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes(NODE, importance, k) numbered in the total order, and the confident edges as (a, c) of caller's and callee's numbers.

    Walks then compare, join and shuffle whole numbers alone. importance has a row for every node.
    """
    ids = cut(positions(importance.select(*NODE, "importance"), F.desc("importance"), *NODE).withColumnRenamed("pos", "k"), "walk-nodes")
    side = lambda cols, to: ids.select(*[F.col(n).alias(c) for c, n in zip(cols, NODE, strict=True)], F.col("k").alias(to))
    links = edges.filter("confident").select(*CALLER, *CALLEE).join(side(CALLER, "a"), CALLER).join(side(CALLEE, "c"), CALLEE)
    return ids, cut(links.select("a", "c"), "walk-links", "snappy")


def _named(rows: DataFrame, ids: DataFrame, number: str, cols: list[str], importance: bool = False) -> DataFrame:
    """rows with the node of a number in the given columns instead of it."""
    names = ids.select(F.col("k").alias(number), *[F.col(n).alias(c) for c, n in zip(cols, NODE, strict=True)], *(["importance"] if importance else []))
    return rows.join(names, number).drop(number)


def blast_radius(edges: DataFrame, importance: DataFrame, roots: DataFrame, depth: int = DEPTH, cap: int = LEVEL_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omissions) of the upstream walk from each of roots(root, rel_fname, name, line), all roots in one job.

    Each level keeps the first cap new callers; omitted ones never come back and are never expanded. importance has a
    row for every node of edges; roots that it lacks have no walk.
    """
    ids, links = _numbered(edges, importance)
    front = roots.select("root", *NODE).join(ids.select(*NODE, "k"), NODE).select("root", "k")
    seen = front.withColumn("kept", F.lit(True))
    kept_all, edge_all, omit_all = [], [], []
    for d in range(1, depth + 1):
        pairs = links.join(front.withColumnRenamed("k", "c"), "c").join(seen.withColumnRenamed("k", "a"), ["root", "a"], "left")
        pairs = cut(pairs.select("root", "a", "c", "kept"), "walk-pairs", "snappy")
        new = pairs.filter("kept IS NULL").select("root", F.col("a").alias("k")).distinct()
        new = cut(new.withColumn("kept", F.row_number().over(Window.partitionBy("root").orderBy("k")) <= cap), "walk-level", "snappy")
        front = new.filter("kept").select("root", "k")
        met = pairs.join(front.select("root", F.col("k").alias("a"), F.lit(True).alias("fresh")), ["root", "a"], "left")
        kept_all.append(front.withColumn("depth", F.lit(d)))
        edge_all.append(met.filter("kept OR fresh").select("root", "a", "c", F.lit(d).alias("depth")))
        omit_all.append(new.filter("NOT kept").groupBy("root").agg(F.count("*").alias("omitted_count")).withColumn("depth", F.lit(d)))
        seen = seen.unionByName(new)
    one = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    reached = _named(_named(one(edge_all), ids, "a", CALLER), ids, "c", CALLEE)
    return _named(one(kept_all), ids, "k", NODE, True), reached, one(omit_all)


def call_trace(edges: DataFrame, importance: DataFrame, roots: DataFrame, depth: int = DEPTH, cap: int = RELATED_CAP) -> tuple[DataFrame, DataFrame]:
    """(steps, branches) of the greedy downstream path from each of roots(root, rel_fname, name, line).

    steps: root, depth, caller and callee node, loops (the callee was visited: the walk stops there). branches: root,
    depth, pos, alternate node, omitted. importance has a row for every node of edges.
    """
    ids, links = _numbered(edges, importance)
    own = Window.partitionBy("a")
    ranked = links.withColumn("n", F.count("*").over(own)).withColumn("pos", F.row_number().over(own.orderBy("c")))
    ranked = cut(ranked.filter(F.col("pos") <= cap + 1), "trace-ranked", "snappy")
    front = roots.select("root", *NODE).join(ids.select(*NODE, "k"), NODE).select("root", F.col("k").alias("a"), F.array("k").alias("path"))
    steps, branches = [], []
    for d in range(1, depth + 1):
        at = front.join(ranked, "a").withColumn("loops", F.col("pos").eqNullSafe(1) & F.array_contains("path", F.col("c")))
        first = at.filter("pos = 1")
        steps.append(first.select("root", F.lit(d).alias("depth"), "a", "c", "loops"))
        others = at.join(first.filter("NOT loops").select("root"), "root", "left_semi").filter("pos > 1")
        branches.append(others.select("root", F.lit(d).alias("depth"), (F.col("pos") - 1).alias("pos"), "c", F.greatest(F.col("n") - 1 - cap, F.lit(0)).alias("omitted")))
        front = first.filter("NOT loops").select("root", F.col("c").alias("a"), F.concat("path", F.array("c")).alias("path"))
    one = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return _named(_named(one(steps), ids, "a", CALLER), ids, "c", CALLEE), _named(one(branches), ids, "c", CALLEE)


def nearest_def(probes: DataFrame, defs: DataFrame) -> DataFrame:
    """probes(probe, rel_fname, name, at_line) with the same-name definition of the nearest line; ties: least tag_seq; misses stay, null.

    Definitions and probes of a name lie in one order of lines, where each probe takes the last definition before it and
    the first one after it; they are never paired.
    """
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    asked = probes.distinct()
    d = defs.filter("rel_fname IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL").groupBy("rel_fname", "name", F.col("start_line").alias("line")).agg(F.min(F.struct("tag_seq")).alias("seq"))
    d = d.select("rel_fname", "name", F.col("line").alias("gl_at"), F.struct("line", "seq").alias("gl_def"), *[none(c, t) for c, t in probes.dtypes if c not in ("rel_fname", "name")], F.lit(0).alias("gl_kind"))
    q = asked.select("rel_fname", "name", F.col("at_line").alias("gl_at"), none("gl_def", d.schema["gl_def"].dataType), *[c for c in probes.columns if c not in ("rel_fname", "name")], F.lit(1).alias("gl_kind"))
    own = Window.partitionBy("rel_fname", "name").rowsBetween(Window.unboundedPreceding, 0)
    near = lambda order: F.last("gl_def", ignorenulls=True).over(own.orderBy(order, "gl_kind"))
    met = d.unionByName(q).withColumn("before", near(F.asc("gl_at"))).withColumn("after", near(F.desc("gl_at"))).filter("gl_kind = 1")
    gap = lambda c: F.when(F.col(c).isNotNull() & F.col("at_line").isNotNull(), F.struct(F.abs(F.col(c)["line"] - F.col("at_line")).alias("gap"), F.col(c)["seq"].alias("seq"), F.col(c)["line"].alias("line")))
    return met.select(*probes.columns, F.array_min(F.array_compact(F.array(gap("before"), gap("after"))))["line"].alias("line"))


def positions(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with pos, from 1, in the given total order; the rows are sorted in ranges, and no task holds all."""
    ranged = cut(rows.orderBy(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("own", own).join(F.broadcast(before), "range").withColumn("pos", (F.col("before") + F.col("own")).cast("int")).drop("range", "own", "before")


def best_def(names: DataFrame, importance: DataFrame) -> DataFrame:
    """names(name) with found and the most important node of that name."""
    order = F.struct((-F.col("importance")).alias("i"), F.col("rel_fname"), F.col("line"))
    best = importance.groupBy("name").agg(F.min(order).alias("best"))
    return names.join(best, "name", "left").select("name", F.col("best").isNotNull().alias("found"), F.col("best.rel_fname").alias("rel_fname"), F.col("best.line").alias("line"), (-F.col("best.i")).alias("importance"))


def navigate(probes: DataFrame, index: DataFrame, symbols: DataFrame) -> DataFrame:
    """probes(probe, rel_fname, name) with line: the first line of that name in the file by index(rel_fname, name, line), else of a symbol of symbols(symbol, line) that is the name, up to its parenthesis; null for neither."""
    first = index.groupBy("rel_fname", "name").agg(F.min("line").alias("own"))
    spelled = symbols.groupBy(F.trim(F.substring_index("symbol", "(", 1)).alias("name")).agg(F.min("line").alias("other"))
    out = probes.join(first, ["rel_fname", "name"], "left").join(spelled, "name", "left")
    return out.select("probe", F.coalesce("own", "other").alias("line"))


def outermost(points: DataFrame, spans: DataFrame, key: str, at: str, span: tuple[str, str], seq: str, bucket: int) -> DataFrame:
    """points with found: the span of equal key that holds `at` and begins first, ties by seq, as a walk in source order meets it; points within none are dropped."""
    inside = (F.col("found")[span[0]] <= F.col(at)) & (F.col(at) <= F.col("found")[span[1]])
    met = _stabbed(points, spans, key, at, span, bucket).filter(inside)
    return met.groupBy(*points.columns).agg(F.min_by("found", F.struct(F.col("found")[span[0]], F.col("found")[seq])).alias("found"))


def overlap_counts(spans: DataFrame) -> DataFrame:
    """spans(key, seq, s, e) with overlaps: how many others of the key share a part of [s, e), by two ordered counts instead of pairs.

    Others that begin before the end, less those that end before the start. An empty span lies within those that begin
    before it and end after it.
    """
    begins = Window.partitionBy("key").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, 0)
    points = spans.groupBy("key", F.col("s").alias("at")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(1))
    asks = spans.select("key", F.col("e").alias("at")).distinct().select("key", "at", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
    before = points.select("key", "at", "n", "kind").unionByName(asks).withColumn("began", F.sum("n").over(begins)).filter("kind = 0").select("key", F.col("at").alias("e"), "began")
    points = spans.groupBy("key", F.col("e").alias("at")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(0))
    asks = spans.select("key", F.col("s").alias("at")).distinct().select("key", "at", F.lit(0).cast("long").alias("n"), F.lit(1).alias("kind"))
    after = points.select("key", "at", "n", "kind").unionByName(asks).withColumn("ended", F.sum("n").over(begins)).filter("kind = 1").select("key", F.col("at").alias("s"), "ended")
    empty = spans.filter("s = e").groupBy("key", "s", "e").agg(F.count("*").alias("empty"))
    out = spans.join(before, ["key", "e"]).join(after, ["key", "s"]).join(empty, ["key", "s", "e"], "left")
    own = F.when(F.col("s") < F.col("e"), 1).otherwise(0)
    return out.select("key", "seq", "s", "e", (F.col("began") - F.col("ended") + F.coalesce("empty", F.lit(0)) - own).alias("overlaps"))
