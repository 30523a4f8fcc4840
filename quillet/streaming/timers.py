"""State with event-time timers: messages that expire, and one rebuild for many changes.

Both are transformWithState processors: state lives in the checkpoint (RocksDB), timers fire when the watermark passes
them, so a restart goes on where the stream stopped, and nothing depends on the clock of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """The session keeps state in RocksDB, which timers need; before the first query with state starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


#: Messages wait in so many groups, by a hash of their ids: state is read and written once a group, not once a message.
GROUPS = 512
_waiting = pa.schema([("id", pa.int64()), ("box", pa.int64()), ("status", pa.string()), ("expires_ms", pa.int64())])


class Expiry(StatefulProcessor):
    """Messages wait in state until the watermark passes their expiry; acknowledged or deleted ones stop waiting.

    A group's messages are one value, and it has one timer: at the first expiry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary, first_ms bigint")

    def _get(self) -> tuple[pa.Table, int | None]:
        if not self.waiting.exists():
            return _waiting.empty_table(), None
        data, first = self.waiting.get()
        return pa.ipc.open_stream(data).read_all(), first

    def _put(self, rows: pa.Table, timer: int | None) -> None:
        """Keep rows; timer: when the timer that is set fires, None without one."""
        first = pc.min(rows.column("expires_ms")).as_py()
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.waiting.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _waiting) as out:
            out.write_table(rows.combine_chunks())
        self.waiting.update((sink.getvalue().to_pybytes(), first))
        if timer != first:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts_ms", "gone"], kind="stable").drop_duplicates("id", keep="last")
        old, timer = self._get()
        stay = old.filter(pc.invert(pc.is_in(old.column("id"), pa.array(new["id"], pa.int64()))))
        come = new[~new["gone"].astype(bool)]
        box = pa.array([None if pd.isna(x) else int(x) for x in come["box"]], pa.int64())
        status = pa.array([None if pd.isna(x) else x for x in come["status"]], pa.string())
        come = pa.Table.from_arrays([pa.array(come["id"], pa.int64()), box, status, pa.array(come["expires_ms"], pa.int64())], schema=_waiting)
        self._put(pa.concat_tables([stay, come]), timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows, timer = self._get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        due = pc.less_equal(rows.column("expires_ms"), timerValues.getCurrentWatermarkInMs())
        self._put(rows.filter(pc.invert(due)), None)  # a timer that has fired is gone
        out = rows.filter(due).to_pandas(integer_object_nulls=True)
        yield out.astype({"box": "Int64"})

    def close(self) -> None:
        pass


def expired_messages(messages: DataFrame, delay: str = "1 hour", gone: Column | None = None) -> DataFrame:
    """id, box, status, expires_ms of the messages of a stream (id bigint, box bigint, ts, status, ttl_hours) that expire, when they do.

    A message expires ttl_hours after ts, as soon as the watermark (the latest ts less delay) has reached that. A later
    row of the same id takes the place of the one before. gone: marks rows after which an id expires no more. Messages
    without id, ts or ttl_hours go. Expiry that the watermark has passed already fires with the next batch.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = messages.where("id is not null and ts is not null and ttl_hours is not null").select(
        F.col("id").cast("long").alias("id"), F.col("box").cast("long").alias("box"), "status", F.col("ts").cast("timestamp").alias("ts"), ms.alias("ts_ms"), (ms + F.col("ttl_hours").cast("long") * 3_600_000).alias("expires_ms"),
        F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"),
    )
    with_state_store(messages.sparkSession)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(GROUPS)))
    return rows.withWatermark("ts", delay).groupBy("grp").transformWithStateInPandas(Expiry(), "id bigint, box bigint, status string, expires_ms bigint", "append", "eventTime")


class Rebuilds(StatefulProcessor):
    """The first change after a rebuild asks for one a cool-down later; changes till then are part of it."""

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first_ms bigint, due_ms bigint, changes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes = pd.concat(list(rows))["ts_ms"].sort_values().tolist()  # one batch's changes of one table
        first, due, n = self.pending.get() if self.pending.exists() else (None, None, 0)
        out = []
        for t in map(int, changes):
            if first is not None and t >= due:
                out.append((first, due, n))
                self.handle.deleteTimer(due)
                first = None
            if first is None:
                first, due, n = t, t + self.cooldown_ms, 0
                self.handle.registerTimer(due)
            n += 1
        self.pending.update((first, due, n))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["name", "first_ms", "due_ms", "changes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.pending.exists() and self.pending.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            first, due, n = self.pending.get()
            self.pending.clear()
            yield pd.DataFrame({"name": [key[0]], "first_ms": [first], "due_ms": [due], "changes": [n]})

    def close(self) -> None:
        pass


def rebuilds(changes: DataFrame, cooldown: int = 15_000, delay: str = "0 seconds") -> DataFrame:
    """name, first_ms, due_ms, changes: when each table of a stream of changes (name string, ts) has to be rebuilt.

    The first change after a rebuild is followed by one `cooldown` milliseconds later, which makes up for all changes in
    between; a change at that moment or later asks for another. Changes of one batch are taken in order of time.
    """
    rows = changes.where("ts is not null").select("name", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    with_state_store(changes.sparkSession)
    return rows.withWatermark("ts", delay).groupBy("name").transformWithStateInPandas(Rebuilds(cooldown), "name string, first_ms bigint, due_ms bigint, changes bigint", "append", "eventTime")
