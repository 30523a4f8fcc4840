"""Messages in boxes: a table (id, box, ts, status, ttl_hours, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TTL_HOURS, GLOBAL_BOX = 72, "_global"


def sent(rows: DataFrame, now: Column) -> DataFrame:
    """New messages, unread, of rows (box, sender, subject, body; optional priority, ttl_hours, ref); their ids are hashes of what they say and when."""
    has = lambda c, default, kind: (F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)).cast(kind).alias(c)
    digest = F.sha2(F.concat_ws("\x1f", "box", "sender", "subject", "body", now.cast("string")), 256)
    return rows.select(
        F.concat(F.lit("msg_"), F.substring(digest, 1, 8)).alias("id"), F.col("box").cast("string").alias("box"), "sender", "subject", "body", now.alias("ts"), F.lit("unread").alias("status"),
        has("ttl_hours", DEFAULT_TTL_HOURS, "int"), has("priority", "normal", "string"), has("ref", None, "string"),
    )


def send(spark, to: str, subject: str, body: str, now: Column, sender: str = "agent", priority: str = "normal", ttl_hours: int = DEFAULT_TTL_HOURS, ref: str | None = None) -> DataFrame:
    """One new message."""
    kind = "box string, sender string, subject string, body string, ttl_hours int, priority string, ref string"
    return sent(spark.createDataFrame([(to, sender, subject, body, ttl_hours, priority, ref)], kind), now)


def broadcast(spark, subject: str, body: str, now: Column, **more) -> DataFrame:
    return send(spark, GLOBAL_BOX, subject, body, now, **more)


def live(now: Column) -> Column:
    """Not older than its hours; unknown times never expire."""
    age = F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))
    return F.coalesce(age <= F.col("ttl_hours").cast("long") * F.lit(3_600_000_000), F.lit(True))


def listed(messages: DataFrame, now: Column, box=None, status: str | None = None, include_expired: bool = False) -> DataFrame:
    """Messages of a box (None: all) that live and have a time, oldest first."""
    m = messages.where(F.col("ts").isNotNull())
    m = m if box is None else m.where(F.col("box") == box)
    m = m if status is None else m.where(F.col("status") == status)
    return (m if include_expired else m.where(live(now))).orderBy("ts", "id")


def next_unread(messages: DataFrame, now: Column) -> DataFrame:
    """The oldest live unread message of each box."""
    w = Window.partitionBy("box").orderBy("ts", "id")
    m = messages.where(F.col("ts").isNotNull() & (F.col("status") == "unread") & live(now))
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def marked(messages: DataFrame, ids: DataFrame, status: str, only: str | None = None) -> DataFrame:
    """messages with the status of ids set: read (only: those unread) or acked."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    change = F.col("_hit").isNotNull() & (F.lit(True) if only is None else F.col("status") == only)
    return messages.join(hit, "id", "left").withColumn("status", F.when(change, status).otherwise(F.col("status"))).select(*messages.columns)


def removed(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("id").distinct(), "id", "left_anti")


def cleanup(messages: DataFrame, now: Column, box=None) -> DataFrame:
    """The messages that stay: those that live, or lie in another box."""
    stay = live(now) if box is None else live(now) | (F.col("box") != box)
    return messages.where(stay)


def cleanup_counts(messages: DataFrame, now: Column) -> DataFrame:
    return messages.groupBy("box").agg(F.count_if(~live(now)).alias("cleaned"), F.count_if(live(now)).alias("remaining"))


def stats(messages: DataFrame) -> DataFrame:
    """box, total, unread of each box, expired messages too, and of all (box null)."""
    return messages.rollup("box").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "unread").alias("unread"))
