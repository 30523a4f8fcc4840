"""The similarity graph: edges, components, hubs, summaries, neighbours, and retrieval guided by it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.keyword import fuse, search
from quillet.operators.similarity import cross, pairs
from quillet.sources.held import held

#: So many edges, both ways counted, are a task's work.
FEW_EDGES = 200_000
EDGE_THRESHOLD, HUB_DEGREE, HUB_CAP, CLUSTER_HUBS, NEIGHBOUR_CAP = 0.6, 3, 30, 5, 10


def edges(vectors: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """src, dst, weight (3 decimals), both ways, for pairs whose unrounded similarity is threshold or more."""
    one = pairs(vectors, threshold).select("a", "b", F.round("sim", 3).alias("weight"))
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return one.select(F.explode(both).alias("e"), "weight").select("e.src", "e.dst", "weight")


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "id")


def hubs(graph: DataFrame, least: int = HUB_DEGREE, cap: int = HUB_CAP) -> DataFrame:
    """id, degree of the nodes with the most neighbours; ties by id."""
    return degrees(graph).where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(cap)


def components(graph: DataFrame) -> DataFrame:
    """id, root (the smallest id of its component) of every node with an edge.

    In each round a node takes the smallest root of itself and its neighbours, and then that root's own root, so the
    distance to it halves; rounds end when no root changes. Up to FEW_EDGES edges are solved in one task instead.
    Of the edges of a task a spanning forest is kept, so what is written and joined grows with the nodes.
    """
    graph = graph.select("src", "dst")
    whole = all(f.dataType.simpleString() == "bigint" for f in graph.schema)
    graph = held(graph.mapInArrow(forest, "src bigint, dst bigint") if whole else graph, "graph")
    if graph.count() <= FEW_EDGES and whole:
        return held(graph.repartition(1).mapInArrow(few_components, "id bigint, root bigint"), "roots")
    label = held(graph.select(F.col("src").alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    while True:
        near = graph.join(label, graph.dst == label.id).groupBy("src").agg(F.min("root").alias("near"))
        hop = label.join(near, label.id == near.src).select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = label.select(F.col("id").alias("root"), F.col("root").alias("above"))
        now = held(hop.join(up, "root").select("id", F.least("root", "above").alias("root"), "was"), "roots")
        if now.where("root <> was").isEmpty():
            return now.select("id", "root")
        label = now.select("id", "root")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task's nodes with a root of their own component among its edges, both ways; a node alone has itself, a null end counts for nothing."""
    ids, root = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted; the place of each id's root
    for batch in batches:
        a, b = batch.column("src").to_numpy(), pc.coalesce(batch.column("dst"), batch.column("src")).to_numpy()
        new = np.setdiff1d(np.concatenate([a, b]), ids)
        if len(new):
            every = np.concatenate([ids, new])
            order = np.argsort(every)
            place = np.empty(len(every), np.int64)
            place[order] = np.arange(len(every))
            ids, root = every[order], place[np.concatenate([root, np.arange(len(ids), len(every))])[order]]
        ra, rb = root[np.searchsorted(ids, a)], root[np.searchsorted(ids, b)]
        differ = np.flatnonzero(ra != rb)
        if len(differ):
            above: dict[int, int] = {}

            def top(x: int, above: dict[int, int] = above) -> int:
                while (y := above.get(x, x)) != x:
                    above[x] = x = above.get(y, y)
                return x

            for x, y in np.unique(np.stack([ra[differ], rb[differ]], 1), axis=0).tolist():
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
            to = np.arange(len(ids))
            old = np.fromiter(above, np.int64, len(above))
            to[old] = [top(x) for x in old.tolist()]
            root = to[root]
    inner = np.flatnonzero(root != np.arange(len(root)))
    alone = np.setdiff1d(np.arange(len(root)), np.concatenate([inner, root[inner]]))
    src, dst = np.concatenate([inner, root[inner], alone]), np.concatenate([root[inner], inner, alone])
    for i in range(0, len(src), 1 << 16):
        yield pa.RecordBatch.from_pydict({"src": ids[src[i : i + (1 << 16)]], "dst": ids[dst[i : i + (1 << 16)]]})


def few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of the edges of one task, by union-find."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("src", "dst")), strict=True):
            a = root(a)
            if b is not None and (b := root(b)) != a:
                above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict({"id": pa.array(list(above), pa.int64()), "root": pa.array([root(x) for x in list(above)], pa.int64())})


def numbered_by(rows: DataFrame, order: str) -> DataFrame:
    """rows with n, their numbers from 0 in the order of a column: a range sort, and counts of its partitions summed up."""
    place = F.monotonically_increasing_id()
    rows = held(rows.orderBy(order).withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    parts = rows.groupBy("_part").agg(F.count("*").alias("c"))  # one row per partition
    before = parts.select("_part", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def clusters(graph: DataFrame, order: DataFrame) -> DataFrame:
    """id, cluster (cluster_<n>) of every node with an edge; n from 0 in the order (id, ord) of the clusters' first members."""
    return named(components(graph), order)


def named(roots: DataFrame, order: DataFrame) -> DataFrame:
    """clusters() of labels (id, root)."""
    c = roots.join(order, "id")
    numbered = numbered_by(c.groupBy("root").agg(F.min("ord").alias("first")), "first")
    return c.join(numbered, "root").select("id", F.concat(F.lit("cluster_"), F.col("n").cast("string")).alias("cluster"))


def stats(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """nodes, edges, isolated, hubs, avg_degree (1 decimal): one row."""
    d = nodes.select("id").join(degrees(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.agg(
        F.count("*").alias("nodes"),
        F.floor(F.sum("degree") / 2).alias("edges"),
        F.count_if(F.col("degree") == 0).alias("isolated"),
        F.least(F.count_if(F.col("degree") >= HUB_DEGREE), F.lit(HUB_CAP)).alias("hubs"),
        F.round(F.sum("degree") / F.greatest(F.count("*"), F.lit(1)), 1).alias("avg_degree"),
    )


def summaries(nodes: DataFrame, graph: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, size, top_hubs (up to five hub ids by degree), tags (distribution of the raw tags strings, empty ones left out)."""
    m = members.join(nodes.select("id", "tags"), "id").join(hubs(graph).select("id", F.col("degree").alias("hub_degree")), "id", "left")
    tags = m.where("tags <> ''").groupBy("cluster", "tags").agg(F.count("*").alias("n"))
    tags = tags.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tags", "n")))).alias("tags"))
    hub = F.array_sort(F.collect_list(F.when(F.col("hub_degree").isNotNull(), F.struct((-F.col("hub_degree")).alias("d"), "id"))))
    per = m.groupBy("cluster").agg(F.count("*").alias("size"), F.slice(F.transform(hub, lambda h: h["id"]), 1, CLUSTER_HUBS).alias("top_hubs"))
    return per.join(tags, "cluster", "left")


def neighbours(graph: DataFrame, starts: DataFrame, hops: int = 1, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """start, id, weight, rank (from 0): up to cap nodes within hops of each start (column id), heaviest first, ties as found.

    A node's weight is the product of the edges' along the path that finds it first: breadth first, parents in the order
    they were found, edges in the order of their ends.
    """
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select("start", F.col("id").alias("src"), F.col("weight").alias("w"), F.col("pos").alias("parent"))
        found = front.join(graph, "src").select("start", F.col("dst").alias("id"), (F.col("w") * F.col("weight")).alias("weight"), "parent")
        found = found.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        first = Window.partitionBy("start", "id").orderBy("parent")
        found = found.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
        at = Window.partitionBy("start").orderBy("parent", "id")
        found = found.select("start", "id", "weight", F.row_number().over(at).cast("long").alias("pos"), F.lit(hop).alias("hop"))
        found = held(found, "frontier") if hop < hops else found
        seen = seen.unionByName(found)
    w = Window.partitionBy("start").orderBy(F.desc("weight"), "hop", "pos")
    ranked = seen.where("hop > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return ranked.select("start", "id", F.round("weight", 9).alias("weight"), (F.col("rn") - 1).alias("rank"))


def guided(base: DataFrame, corpus: DataFrame, graph: DataFrame, members: DataFrame, text: str, top_k: int = 5, use_cluster: bool = True, expand: bool = True, hops: int = 1) -> DataFrame:
    """id, score, method, global_rank, cluster_rank, expanded_from, edge_weight: retrieval guided by the graph.

    base: the global hybrid result (id, score, rank from 0) of twice top_k rows. The clusters of its first three rows are
    searched by words, with counts of their own, and fused by rank with the whole of base (0.6 to 0.4). If fewer than
    top_k rows result, neighbours of the first three follow, with half their score times the edge's weight.
    """
    spark = corpus.sparkSession
    null = lambda t: F.lit(None).cast(t)
    if not use_cluster and not expand:
        return base.orderBy("rank").limit(top_k).select("id", "score", F.lit("global").alias("method"), null("int").alias("global_rank"), null("int").alias("cluster_rank"), null("string").alias("expanded_from"), null("double").alias("edge_weight"))
    base = held(base, "base")
    seeds = base.where("rank < 3").join(members, "id").select("cluster").distinct() if use_cluster else None
    if use_cluster and not seeds.isEmpty():
        inside = corpus.join(members.join(seeds, "cluster", "left_semi").select("id"), "id", "left_semi")
        words = search(inside, spark.createDataFrame([(0, text)], "qid int, query string"), 2 * top_k)
        fused = fuse([(base, 0.6), (words, 0.4)])
        ranked = fused.select("id", "score", F.col("rank0").alias("global_rank"), F.col("rank1").alias("cluster_rank"), "best")
    else:
        ranked = base.select("id", "score", F.col("rank").alias("global_rank"), null("int").alias("cluster_rank"), F.struct(F.lit(0).alias("list"), F.col("rank").alias("rank")).alias("best"))
    order = Window.orderBy(F.desc(F.round("score", 12)), "best", "id")
    ranked = held(ranked.withColumn("place", F.row_number().over(order) - 1), "ranked")
    top = ranked.where(F.col("place") < top_k).select("id", "score", "global_rank", "cluster_rank", null("bigint").alias("expanded_from"), null("double").alias("edge_weight"), "place")
    have = top.count()
    if expand and have < top_k:
        from_ = ranked.where("place < 3")
        near = neighbours(graph, from_.select("id"), hops).join(from_.select(F.col("id").alias("start"), F.col("score").alias("from_score"), F.col("place").alias("from_place")), "start")
        near = near.join(top.select("id"), "id", "left_anti")
        first = Window.partitionBy("id").orderBy("from_place", "rank")
        near = near.withColumn("rn", F.row_number().over(first)).where("rn = 1").orderBy("from_place", "rank").limit(top_k - have)
        added = near.select("id", (F.col("from_score") * F.col("weight") * 0.5).alias("score"), null("int").alias("global_rank"), null("int").alias("cluster_rank"), F.col("start").cast("bigint").alias("expanded_from"), F.col("weight").alias("edge_weight"), (F.lit(top_k) + F.col("from_place") * 1000 + F.col("rank")).alias("place"))
        top = top.unionByName(added)
    return top.orderBy(F.desc(F.round("score", 12)), "place").limit(top_k).select("id", F.round("score", 4).alias("score"), F.lit("graph-guided").alias("method"), "global_rank", "cluster_rank", "expanded_from", "edge_weight")


def formatted(results: DataFrame, memories: DataFrame) -> DataFrame:
    """results with text, source and tags of the rows they name, as a search gives them; ids that are gone have none."""
    return results.join(memories.select("id", "text", "source", "tags"), "id", "left")


class GraphCache:
    """Edges and clusters of a similarity graph under path, with the time they were built at."""

    def __init__(self, spark, path: str, hours: int = 24):
        self.spark, self.path, self.hours = spark, path.rstrip("/"), hours

    def write(self, vectors: DataFrame, now: Column, threshold: float = EDGE_THRESHOLD) -> None:
        """Build anew: one pass over all pairs. vectors: id, ord, embedding."""
        graph = held(edges(vectors, threshold), "edges")
        stamp = f"{self.path}/{uuid.uuid4().hex[:12]}"
        graph.write.parquet(f"{stamp}-edges")
        components(graph).write.parquet(f"{stamp}-roots")
        self._name(stamp, vectors.select("id", "ord"), now, threshold)

    def update(self, vectors: DataFrame, now: Column, new: DataFrame, gone: DataFrame, threshold: float = EDGE_THRESHOLD) -> int:
        """The newest build with rows changed: new (ids) of vectors (id, ord, embedding, after the change) came, gone (ids) went.

        New vectors alone are compared with all; components are worked out anew where an edge comes or goes. How many
        nodes' components were. Of a row that changed, the id is both gone and new. Without a build, one is made.
        """
        from quillet.operators import changes

        last = self._newest(threshold)
        if last is None:
            self.write(vectors, now, threshold)
            return vectors.count()
        before = self.spark.read.parquet(f"{last}-edges")
        labels = self.spark.read.parquet(f"{last}-roots")
        came = vectors.join(new.select("id").distinct(), "id", "left_semi").select("id", "embedding")
        fresh = cross(came, vectors.select("id", "embedding"), threshold).where("a <> b")
        pair = fresh.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("sim", 3).alias("weight"))
        fresh = held(pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).dropDuplicates(["src", "dst"]), "fresh")
        lost = gone.select("id").distinct()
        removed = before.join(lost, before.src == lost.id, "left_semi").unionByName(before.join(lost, before.dst == lost.id, "left_semi")).select("src", "dst").distinct()
        removed = held(removed, "removed")
        roots, touched = changes.updated(labels, before.select("src", "dst"), fresh.select("src", "dst"), removed)
        stamp = f"{self.path}/{uuid.uuid4().hex[:12]}"
        before.join(removed, ["src", "dst"], "left_anti").unionByName(fresh).write.parquet(f"{stamp}-edges")
        roots.write.parquet(f"{stamp}-roots")
        self._name(stamp, vectors.select("id", "ord"), now, threshold)
        return touched

    def _name(self, stamp: str, order: DataFrame, now: Column, threshold: float) -> None:
        """Number the clusters of a build and note it, which makes it count."""
        named(self.spark.read.parquet(f"{stamp}-roots"), order).write.parquet(f"{stamp}-clusters")
        self.spark.range(1).select(now.alias("built_at"), F.lit(stamp).alias("stamp"), F.lit(threshold).alias("threshold")).write.mode("append").parquet(f"{self.path}/built")

    def _newest(self, threshold: float) -> str | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/built").where(F.col("threshold") == threshold).orderBy(F.desc("built_at")).limit(1).collect()
        except AnalysisException:
            return None
        return rows[0].stamp if rows else None

    def fresh(self, now: Column, threshold: float = EDGE_THRESHOLD) -> tuple[DataFrame, DataFrame] | None:
        """Edges and clusters of the newest build with this threshold, if it is younger than `hours`."""
        try:
            built = self.spark.read.parquet(f"{self.path}/built")
        except AnalysisException:
            return None
        age = F.unix_micros(now) - F.unix_micros("built_at")
        rows = built.where((F.col("threshold") == threshold) & (age >= 0) & (age < self.hours * 3_600_000_000)).orderBy(F.desc("built_at")).limit(1).collect()
        return tuple(self.spark.read.parquet(f"{rows[0].stamp}-{x}") for x in ("edges", "clusters")) if rows else None

    def load(self, vectors: DataFrame, now: Column, threshold: float = EDGE_THRESHOLD, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
        """The fresh index, or a new one."""
        found = None if rebuild else self.fresh(now, threshold)
        if found is None:
            self.write(vectors, now, threshold)
            found = self.fresh(now, threshold)
        return found
