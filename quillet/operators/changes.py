"""Components of a graph kept up as edges and nodes come and go, with work in proportion to the change.

Labels (id, root) name each node's component by its smallest id, as graph.components() gives them. New edges join whole
components, so they are contracted: each end is replaced by its root, the few contracted edges are solved, and the roots
that lose their place get a new one. Edges that go can only split the components they were in, so these alone are solved
again, from their own edges. Everything else keeps its labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators.graph import components
from quillet.sources.held import held


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def after_additions(labels: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New labels of the nodes that change, and the roots (id) that are no roots any more. added: src, dst, one way at least.

    Nodes without a label are components of their own till now.
    """
    root = labels.select(F.col("id").alias("src"), F.col("root").alias("r"))
    ends = both_ways(added).where("src is not null and dst is not null")
    named = held(ends.join(root, "src", "left").select(F.col("src").alias("id"), F.coalesce("r", "src").alias("root"), F.col("r").isNull().alias("new"), "dst"), "ends")
    other = named.select(F.col("id").alias("dst"), F.col("root").alias("to")).distinct()
    contracted = named.select("root", "dst").join(other, "dst").select(F.col("root").alias("src"), F.col("to").alias("dst")).where("src <> dst").distinct()
    tops = held(components(contracted).withColumnRenamed("id", "old"), "tops")
    news = named.where("new").select("id", F.col("id").alias("old")).distinct()
    moved = tops.where("old <> root")
    members = labels.join(moved, labels.root == moved.old, "left_semi").select("id", F.col("root").alias("old"))
    changed = members.unionByName(news).join(tops, "old", "left").select("id", F.coalesce("root", "old").alias("root"))
    return held(changed, "changed"), moved.select(F.col("old").alias("id"))


def after_removals(labels: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """id, root of every node in a component that loses an edge (src, dst); root is null for nodes left without any. edges: those that stay."""
    ends = both_ways(removed).select(F.col("src").alias("id")).distinct()
    hit = labels.join(ends, "id", "left_semi").select("root").distinct()
    members = held(labels.join(hit, "root", "left_semi").select("id"), "members")
    own = edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    solved = components(both_ways(own))
    return held(members.join(solved, "id", "left"), "solved")


def updated(labels: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The labels after edges have gone and come, and how many nodes' labels were worked out anew.

    labels: of the graph before; edges: src, dst of the graph before; removed: some of them; added: new ones; each edge
    may stand one way or both ways. Nodes without an edge have no label.
    """
    touched = 0
    if removed is not None:
        removed = held(both_ways(removed).distinct(), "removed")
        edges = edges.join(removed, ["src", "dst"], "left_anti")
        solved = after_removals(labels, edges, removed)
        touched += solved.count()
        labels = labels.join(solved.select("id"), "id", "left_anti").unionByName(solved.where("root is not null").select(*labels.columns))
        labels = held(labels, "labels")
    if added is not None:
        changed, _ = after_additions(labels, added)
        touched += changed.count()
        labels = labels.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*labels.columns))
    return labels, touched
