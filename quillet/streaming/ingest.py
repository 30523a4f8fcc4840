"""Ingest as a stream, exactly once through the gate and the tiers, and windows of activity. For timers see timers.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.engine import Engine
from quillet.functions.quality import worth_storing
from quillet.operators.mailbox import live
from quillet.sources.held import held


def distinct_texts(stream: DataFrame, time_col: str = "ts", text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """The cheap tier: texts that came already within the delay go, and texts that the gate rejects."""
    s = stream.where(worth_storing(text_col)).withColumn("_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return s.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def ingest(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, every: str | None = "15 seconds", after: Callable[[], None] | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None):
    """Start the stream: enrich and write each micro-batch, then run after (such as a rebuild of the graph) once for it.

    enrich: adds columns to a batch before it is written, such as entities.enriched; so nothing is read, changed and
    written again later, and no update of another writer is lost. every: the trigger's interval; None: all that is there,
    then stop. A batch that failed after it was written is written again; for a table see into_engine().
    """

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write(enrich(batch) if enrich else batch)
            if after:
                after()

    return started(stream, one, checkpoint, every)


def started(stream: DataFrame, one: Callable[[DataFrame, int], None], checkpoint: str, every: str | None):
    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def into_engine(stream: DataFrame, engine: Engine, checkpoint: str, name: str, now: Column | None = None, every: str | None = "15 seconds", extract: bool = True, **thresholds: float):
    """Start a stream of rows (text, source, tags, place, ts) into the engine's table, through the gate and the tiers, each row once.

    Each micro-batch is one call of Engine.write, and its number is noted with the snapshot that has its rows (see
    Snapshots), so a batch that is replayed after a crash, wherever that was, does nothing or all. name: of the stream,
    whose checkpoint counts the batches; a new checkpoint needs a new name. now: the time of writing; None: the latest ts
    of the batch, so that a replay has the same. One query writes one batch after the other, so it is the table's lock.
    """

    def one(batch: DataFrame, number: int) -> None:
        if engine.table.written((name, number)):
            return
        rows = held(batch, "batch")
        if rows.isEmpty():
            engine.table.done((name, number))
            return
        at = now if now is not None else F.lit(rows.agg(F.max("ts").cast("timestamp")).first()[0])
        engine.write(rows.drop("ts"), at, extract, mark=(name, number), **thresholds)

    return started(stream, one, checkpoint, every)


def live_messages(stream: DataFrame, now: Column) -> DataFrame:
    """Messages of a stream that haven't expired at now; expiry is a predicate at read, so no state is kept."""
    return stream.where(live(now))


def counts(stream: DataFrame, window: str = "1 day", delay: str = "2 days", slide: str | None = None) -> DataFrame:
    """window_start, window_end, status, n of a stream of messages in windows of event time; late ones count until the delay is over.

    slide: windows begin so often and overlap; None: as often as they are long. A window comes out when the watermark
    (the latest ts less delay) has passed its end.
    """
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "status").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "status", "n")


def activity(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """box, first_ts, ends_at, n of the sessions of activity of each box in a stream of messages: rows less than gap apart.

    State is merged when a row closes the gap between two sessions. ends_at: the last row's time and gap; a session comes
    out when the watermark has passed it, and rows that come later than that are dropped.
    """
    w = stream.where("box is not null").withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "box").agg(F.count("*").alias("n"))
    return w.select("box", F.col("w.start").alias("first_ts"), F.col("w.end").alias("ends_at"), "n")
