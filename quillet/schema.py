"""Schemas of the store, and the views that the driver's tables give of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = (
    "id string, ord bigint, text string, embedding array<float>, source string, tags array<string>, entities array<struct<text:string,label:string>>, "
    "merged_count int, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, ttl_days int, expire_at timestamp, archived_at timestamp, "
    "needs_review boolean, review_similar_to string, review_similarity double, extra map<string,string>"
)
MESSAGE = "id string, box string, sender string, subject string, body string, ts timestamp, status string, ttl_hours int, priority string, ref string"


def memories_from_documents(docs: DataFrame) -> DataFrame:
    """id, ord, text, source, tags, created_at, ttl_days, expire_at of the documents as memories (derived from doc_id)."""
    from quillet.functions.ttl import ttl_of

    tags = F.expr("element_at(array(array('temporary'), array('dynamic'), array('static'), array('preference', 'temporary'), cast(array() as array<string>)), cast(doc_id % 5 as int) + 1)")
    d = docs.withColumn("tags", tags).withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 400 as int))"))
    d = d.withColumn("ttl", ttl_of("tags"))
    return d.select(
        F.concat(F.lit("mem_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("ord"),
        "text",
        "source",
        "tags",
        "created_at",
        F.when(F.col("doc_id") % 7 != 0, F.col("ttl")).alias("ttl_days"),
        F.when(F.col("doc_id") % 3 != 0, F.col("created_at") + F.expr("make_dt_interval(ttl)")).alias("expire_at"),
    )


def messages_from_events(events: DataFrame) -> DataFrame:
    """id, box, ts, status, ttl_hours of the events as messages."""
    status = F.expr("case when event_type in ('view', 'click') then 'unread' when event_type in ('signup', 'purchase') then 'read' else 'acked' end")
    hours = (F.lit(24) + F.get_json_object("props", "$.k").cast("int")).alias("ttl_hours")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("box"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), hours)
