"""The engine as a whole: a table of memories, its archive and its graph under one folder, and the paths that users call.

Every path is a composition of the operators; the table is replaced or appended to once per call. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.entities import enriched
from quillet.functions.vectors import embed
from quillet.operators import context, dedup, graph, keyword, lifecycle, maintenance, similarity, store
from quillet.operators.vector_index import VectorIndex
from quillet.schema import MEMORY
from quillet.sources.held import held
from quillet.sources.snapshots import Snapshots, restored

PREFIX = "mem_"


def unweighted(texts: DataFrame) -> DataFrame:
    """The default embedder: id, embedding of (id, text), independent of the other texts."""
    return embed(texts, dims=1024, idf=False)


def named(number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit(PREFIX), number.cast("string")))


class Engine:
    """embedder: id, embedding (unit vectors) of (id bigint, text); extractor: see entities.enriched."""

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[DataFrame], DataFrame] = unweighted, enrich: Callable[[DataFrame], DataFrame] = enriched):
        path = path.rstrip("/")
        self.spark, self.embedder, self.enrich = spark, embedder, enrich
        self.index: VectorIndex | None = None
        self.path = path
        self.table, self.archived, self.cache = Snapshots(spark, f"{path}/active", MEMORY), Snapshots(spark, f"{path}/archive", MEMORY), graph.GraphCache(spark, f"{path}/graph")

    def memories(self) -> DataFrame:
        return self.table.read()

    def vectors(self) -> DataFrame:
        """id and ord (both the number of a row), embedding, and the row's other columns but its name."""
        return self.memories().drop("id").withColumn("id", F.col("ord"))

    def write(self, rows: DataFrame, now: Column, extract: bool = True, mark: tuple[str, int] | None = None, **thresholds: float) -> DataFrame | None:
        """Write rows (text, source, tags, place: their order) through the gate and the tiers; id, place, action, best_id, similarity.

        id: the row's own, or of a skipped row that of the row it repeats; null for a rejected one.
        mark: name and number of a stream's batch; one that is in the table already does nothing and gives None.
        """
        if self.table.written(mark):
            return None
        start = self.memories().agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        batch = graph.numbered_by(rows, "place").withColumn("ord", F.col("n") + F.lit(start)).drop("n").withColumn("id", F.col("ord"))
        batch = held(batch.join(self.embedder(batch.select("id", "text")), "id"), "batch")
        old = self.vectors().select("id", "text", "embedding")
        fates = held(dedup.write_batch(batch, old, **thresholds), "fates")
        new = dedup.stored_rows(batch, fates, now)
        new = new.withColumns({"id": named(F.col("id")), "review_similar_to": named(F.col("review_similar_to"))})
        new = held(self.enrich(new) if extract else new, "new")
        # stored rows that flagged ones point to are for review too; without any, rows are added and nothing is rewritten
        points = fates.where("action = 'flagged'").join(batch.select("id", "ord"), "id").groupBy(named(F.col("best_id")).alias("id"))
        points = points.agg(named(F.max_by("id", "ord")).alias("p"), F.max_by("similarity", "ord").alias("s"))
        now_there = self.memories()
        if now_there.join(points, "id", "left_semi").isEmpty():
            self.table.append(new, mark)
        else:
            marked = now_there.join(points, "id", "left").withColumns({"needs_review": F.when(F.col("p").isNotNull(), True).otherwise(F.col("needs_review")), "review_similar_to": F.coalesce("p", "review_similar_to"), "review_similarity": F.coalesce("s", "review_similarity")})
            self.table.write(marked.drop("p", "s").unionByName(new, allowMissingColumns=True), mark)
        if self.index is not None:
            self.index.append(new.select(F.col("ord").alias("id"), "embedding"))
        own = F.when(F.col("action") == "skipped", F.col("best_id")).when(F.col("action") != "rejected", F.col("id"))
        return fates.join(batch.select("id", "place"), "id").select(named(own).alias("id"), "place", "action", named(F.col("best_id")).alias("best_id"), "similarity")

    def delete(self, ids: DataFrame) -> int:
        """Delete the rows of ids; how many distinct ids were asked for."""
        n, left = store.delete(self.memories(), ids)
        self.table.write(left)
        return n

    def build_index(self, **how) -> VectorIndex:
        """Index the vectors that are there, for query(probes=...); rows that are written from now on are added to it.

        Rows that go are left out when results get their texts, so build anew when many have gone.
        """
        self.index = VectorIndex.build(self.vectors().select("id", "embedding"), f"{self.path}/index-{uuid.uuid4().hex[:12]}", **how)
        return self.index

    def query(self, text: str, top_k: int = 5, threshold: float = 0.3, retrieve_k: int | None = None, probes: int | None = None) -> DataFrame:
        """id, similarity, text, source, tags of the rows closest to a text, best first; in two stages with retrieve_k.

        probes: by the index, so many cells of which are read; it has to be built.
        """
        if probes is not None:
            if self.index is None:
                raise ValueError("there is no index: call build_index() first")
            vector = self.vector(text).first().q
            near = self.index.topk(vector, top_k, threshold, max(retrieve_k or 64, top_k), probes)
            return self._named(near).orderBy(F.desc("similarity"), "ord").drop("ord")
        near = similarity.rerank(self.vectors(), self.vector(text), top_k, retrieve_k, threshold) if retrieve_k else similarity.topk(self.vectors(), self.vector(text), top_k, threshold)
        return self._named(near).orderBy(F.desc("similarity"), "ord").drop("ord")

    def vector(self, text: str) -> DataFrame:
        return self.embedder(self.spark.createDataFrame([(0, text)], "id bigint, text string")).select(F.col("embedding").alias("q"))

    def _named(self, found: DataFrame) -> DataFrame:
        rows = self.memories().select(F.col("ord"), F.col("id").alias("name"), "text", "source", "tags", "created_at")
        return found.join(rows, found.id == rows.ord).drop("id").withColumnRenamed("name", "id")

    def guided(self, text: str, now: Column, top_k: int = 5, **how) -> DataFrame:
        """A search guided by the graph, which is built anew if the last one is a day old; with text, source and tags."""
        edges, members = self.cache.load(self.vectors().select("id", "ord", "embedding"), now)
        corpus = self.vectors().select("id", "ord", "text")
        base = keyword.hybrid(self.vectors(), corpus, self.vector(text), text, 2 * top_k)
        order = F.struct((-F.col("score")).alias("s"), F.coalesce("vector_rank", F.lit(2**30)).alias("v"), F.coalesce("bm25_rank", F.lit(2**30)).alias("b"), "id")
        places = F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", "score")))  # 2 x top_k rows
        base = base.agg(places.alias("l")).select(F.posexplode("l").alias("rank", "x")).select("x.id", "x.score", "rank")
        found = graph.guided(base, corpus, edges, members, text, top_k, **how)
        return self._named(found).withColumn("expanded_from", named(F.col("expanded_from"))).drop("ord", "created_at")

    def session_end(self, turns: DataFrame, now: Column) -> DataFrame:
        """The end of conversations (conv_id, turn, role, text): their tails are written, then maintenance counts, then the archive.

        One row: written, conflicts, stale, archived.
        """
        tails = context.session_memories(turns).withColumnRenamed("conv_id", "place")
        fates = held(self.write(tails, now, extract=False), "session")
        counts = self.maintain(now)
        gone = self.archive(now)
        return counts.select(F.lit(fates.where("action in ('added', 'flagged')").count()).alias("written"), "conflicts", "stale", F.lit(gone).alias("archived"))

    def maintain(self, now: Column) -> DataFrame:
        """conflicts, stale: one row."""
        return maintenance.conflict_count(self.memories()).crossJoin(maintenance.stale_count(self.memories(), now))

    def archive(self, now: Column) -> int:
        """Move what is due to the archive; how many rows. After a crash between the two tables, a rerun ends the move."""
        marked = held(lifecycle.split(self.memories(), now), "split")
        due = marked.where("state = 'archived'").drop("state")
        n = due.count()
        if n:
            self.archived.append(due.join(self.archived.read().select("id"), "id", "left_anti"))
            self.table.write(marked.where("state = 'active'").drop("state"))
        return n

    def restore_archived(self, ids: DataFrame) -> int:
        """Move rows back from the archive; how many. After a crash between the two tables, a rerun ends the move."""
        back = held(store.by_ids(self.archived.read(), ids).withColumn("archived_at", F.lit(None).cast("timestamp")), "back")
        n = back.count()
        if n:
            self.table.append(back.join(self.memories().select("id"), "id", "left_anti"))
            self.archived.write(self.archived.read().join(back.select("id"), "id", "left_anti"))
        return n

    def ttl_job(self, now: Column, execute: bool = False) -> DataFrame:
        """Fill in times to live, then preview what is due, or archive it: one row, would_archive or archived."""
        self.table.write(store.backfill_ttl(self.memories()))
        if execute:
            return self.spark.range(1).select(F.lit(self.archive(now)).alias("archived"))
        return lifecycle.preview(self.memories(), now)

    def nightly(self, now: Column, patterns: dict[str, str] = maintenance.NUMERIC, judge=None) -> DataFrame:
        """Conflicts, duplicate sweep and review, in one replacement of the table; id of the rows that went."""
        rows = self.memories().withColumns({"name": F.col("id"), "id": F.col("ord"), "review_similar_to": F.regexp_replace("review_similar_to", PREFIX, "").cast("bigint"), "entity": maintenance.primary_entity(), "ts": F.coalesce("updated_at", "created_at")})
        rows = held(rows, "nightly")
        sweep = held(maintenance.duplicate_sweep(rows.select("id", "ord", "text", "embedding")), "sweep")
        drops, left = maintenance.nightly(rows, patterns, sweep, judge)
        drops = held(drops.join(rows.select("id", "name"), "id").select(F.col("name").alias("id")), "drops")
        self.table.write(left.withColumns({"id": F.col("name"), "review_similar_to": named(F.col("review_similar_to"))}).select(*self.memories().columns))
        return drops

    def restore_backup(self, items: DataFrame, now: Column, suffix: str = "") -> DataFrame:
        """Write backup items (value: JSON) again through the gate and the tiers; what write() gives, with restored_from_id.

        The row that an item ends up in, its own or the one it repeats, is told where it came from and when (extra).
        """
        rows = held(restored(items, suffix).withColumn("place", F.col("restored_from_id")), "restored")
        fates = held(self.write(rows.select("text", "source", "tags", "place"), now, extract=False), "fates")
        patch = fates.where("id is not null").groupBy("id").agg(F.max("place").alias("old"), F.lit(None).cast("array<string>").alias("drop"))
        stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
        patch = patch.select("id", F.create_map(F.lit("restored_from_id"), F.col("old"), F.lit("restored_at"), stamp).alias("set"), "drop")
        self.table.write(store.update(self.memories(), patch))
        return fates.withColumnRenamed("place", "restored_from_id")
