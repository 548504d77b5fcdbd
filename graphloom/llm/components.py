"""Connected components of a link table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in links(a, b); label is the least node of the component.

    Each round points every node to its least neighbour, follows the pointers to their roots, and contracts the links
    to links between roots, until none is left. Rounds grow with the logarithm of the longest chain. Hot nodes only
    meet minima, which fold before the shuffle, and joins against a table with one row a node.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels: DataFrame | None = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "cc-roots")
        while True:  # pointer jumping
            far = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            stepped = materialize(roots.join(far, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "cc-jump")
            moved = stepped.filter("moved").head(1)
            discard(roots)
            roots = stepped.select("node", "root")
            roots._graphloom_path = stepped._graphloom_path
            if not moved:
                break
        if labels is None:
            labels = roots
        else:
            label = roots.select(F.col("node").alias("label"), "root")
            old = labels
            labels = materialize(old.join(label, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "cc-labels")
            discard(old)
        if "root" in labels.columns:
            path = labels._graphloom_path
            labels = labels.select("node", F.col("root").alias("label"))
            labels._graphloom_path = path
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        smaller = edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old = edges
        edges = materialize(smaller, "cc-edges")
        discard(old)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
