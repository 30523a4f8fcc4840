"""Archive and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.ttl import due
from quillet.operators.store import backfill_ttl


def preview(memories: DataFrame, now: Column, examples: int = 5) -> DataFrame:
    """would_archive, kept, examples (the first texts, 80 characters each): one row."""
    marked = memories.withColumn("due", due(now))
    first = marked.where("due").orderBy("ord").limit(examples).select("ord", F.substring("text", 1, 80).alias("text"))
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("examples"))
    return marked.agg(F.count_if("due").alias("would_archive"), F.count_if(~F.col("due")).alias("kept")).crossJoin(first)


def split(memories: DataFrame, now: Column) -> DataFrame:
    """memories with state (active or archived) and archived_at: one snapshot of both tables."""
    d = due(now)
    return memories.withColumn("state", F.when(d, "archived").otherwise("active")).withColumn("archived_at", F.when(F.col("state") == "archived", now))


def restore(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    """The snapshot with archived rows of ids active again; their times stay, so the next run archives them again."""
    back = ids.select("id").distinct().withColumn("_back", F.lit(True))
    joined = snapshot.join(back, "id", "left")
    again = F.coalesce("_back", F.lit(False))
    return joined.withColumns({"state": F.when(again, "active").otherwise(F.col("state")), "archived_at": F.when(~again, F.col("archived_at"))}).select(*snapshot.columns)


def ttl_job(memories: DataFrame, now: Column, execute: bool = False) -> DataFrame:
    """The job in one: times to live are filled in, and then the preview (one row), or the snapshot with what is due archived."""
    filled = backfill_ttl(memories)
    return split(filled, now) if execute else preview(filled, now)
