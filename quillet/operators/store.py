"""The memory table: pages, updates, deletes, statistics, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.ttl import days_later, ttl_of

CHAT_PREFIX = "[对话]"


def page(memories: DataFrame, limit: int = 100, offset: int = 0, needs_review: bool | None = None) -> tuple[int, DataFrame]:
    """total, and the rows offset to offset + limit in the table's order; needs_review filters only if it is True."""
    rows = memories.where("needs_review") if needs_review else memories
    return rows.count(), rows.orderBy("ord").offset(offset).limit(limit)


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def update(memories: DataFrame, patches: DataFrame, replace: bool = False) -> DataFrame:
    """memories with patches (id, set map<string,string>, drop array<string>) applied to their map `extra`.

    replace: the map becomes set; else set is laid over it, and the keys in drop go. Unknown ids do nothing: see unknown().
    Several patches of one id are one: the keys of all, of one key the largest value, and all that any of them drops.
    """
    empty = F.create_map().cast("map<string,string>")
    # maps of one id are few; of equal keys the last entry stays, which is the largest
    entries = F.array_sort(F.flatten(F.collect_list(F.map_entries(F.coalesce("set", empty)))))
    last = F.filter(entries, lambda e, i: (i + 1 == F.size(entries)) | (F.try_element_at(entries, i + 2)["key"] != e["key"]))
    gone = F.array_distinct(F.flatten(F.collect_list(F.coalesce("drop", F.array().cast("array<string>")))))
    p = patches.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(last).alias("set"), gone.alias("drop"))
    old, new = F.coalesce("extra", empty), F.coalesce("set", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)) if not replace else empty
    merged = F.map_filter(F.map_concat(kept, new), lambda k, v: ~F.array_contains(F.coalesce("drop", F.array().cast("array<string>")), k))
    joined = memories.join(p, memories.id == p._id, "left")
    return joined.withColumn("extra", F.when(F.col("_id").isNull(), F.col("extra")).otherwise(merged)).select(*memories.columns)


def unknown(memories: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.select("id").join(memories, "id", "left_anti")


def delete(memories: DataFrame, ids: DataFrame) -> tuple[int, DataFrame]:
    """The number of distinct ids asked for, and the table without them."""
    ids = ids.select("id").distinct()
    return ids.count(), memories.join(ids, "id", "left_anti")


def without_chat(memories: DataFrame) -> DataFrame:
    """Rows whose text doesn't start with the mark of logged dialogues."""
    return memories.where(~F.coalesce(F.col("text").startswith(CHAT_PREFIX), F.lit(False)))


def tag_counts(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def source_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def ttl_counts(memories: DataFrame) -> DataFrame:
    """ttl_days, n; the row with null counts those without."""
    return memories.groupBy("ttl_days").agg(F.count("*").alias("n"))


def overview(memories: DataFrame) -> DataFrame:
    """total_memories, missing_ttl, missing_expire, oldest, newest: one row, one pass."""
    return memories.agg(
        F.count("*").alias("total_memories"),
        F.count_if(F.col("ttl_days").isNull()).alias("missing_ttl"),
        F.count_if(F.col("expire_at").isNull()).alias("missing_expire"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def stats(memories: DataFrame) -> DataFrame:
    """overview with the distributions of tags and sources as maps: one row."""
    def as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return overview(memories).crossJoin(as_map(tag_counts(memories), "tag", "tag_distribution")).crossJoin(as_map(source_counts(memories), "source", "source_distribution"))


def backfill_ttl(memories: DataFrame) -> DataFrame:
    """Rows without ttl_days get it from their tags, last_accessed_at from created_at if absent, and expire_at if absent and created_at is known."""
    lacks = F.col("ttl_days").isNull()
    ttl = ttl_of("tags")
    return memories.withColumns(
        {
            "ttl_days": F.coalesce("ttl_days", ttl),
            "expire_at": F.when(lacks & F.col("expire_at").isNull(), days_later("created_at", ttl)).otherwise(F.col("expire_at")),
            **({"last_accessed_at": F.when(lacks, F.coalesce("last_accessed_at", "created_at")).otherwise(F.col("last_accessed_at"))} if "last_accessed_at" in memories.columns else {}),
        }
    )


def backfill_metadata(memories: DataFrame, now: Column) -> DataFrame:
    """The rows that lack a source, created_at or merged_count, with legacy, now and 0 in their place."""
    lacks = F.coalesce(F.col("source") == "", F.lit(True)) | F.col("created_at").isNull() | F.col("merged_count").isNull()
    return memories.where(lacks).withColumns({"source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("legacy")), "created_at": F.coalesce("created_at", now), "merged_count": F.coalesce("merged_count", F.lit(0))})
