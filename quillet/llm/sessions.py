"""Gap sessionisation as a speculative parallel scan.

Clicks are range-partitioned by client and time, so that a client with a third of all rows spreads over many partitions.
Every partition is scanned at once, as if its first click started a session. That is a guess only for its head: the rows
of its first client before the first hard cut, which is an end, a gap or another client. Whatever state comes in, cuts
agree from there on, and the sessions behind it are final. Then the partitions exchange their boundary states by a join of
each with the one before. A head without a hard cut hands on what it was given, so it is rerun while what it assumed
differs from what the partition before hands on; when nothing differs, cuts agree everywhere, the heads are cut once, and
pieces of a session that lie in several partitions are put together.

Rounds: as many as partitions in a row without any hard cut, plus one. No state leaves the cluster; the driver sees one
boolean a round. A task holds one partition's head and one session at a time.

Odd input: rows without click_id, client_id or ts belong to no session and go. Of several rows of one click_id the first
by (ts, client_id, arrival, kind, value) counts. A click without arrived_at isn't late. A null, NaN or infinite value is
worth nothing, and no purchase of it is final. An empty table gives no sessions. Clients with late clicks alone have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import keyed, stage

MINUTE = 60_000_000
#: Why a session ends, by number; 0: no later click of the client.
REASONS = ("none", "end", "gap", "length")
ORDER = ["client_id", "ts", "late", "click_id"]
#: Sessions, pieces of sessions, rows of heads and boundary states have one schema, so that one pass makes all of them.
SCHEMA = pa.schema(
    [("kind", pa.int8()), ("part", pa.int32()), ("client_id", pa.int64()), ("id", pa.int64()), ("ts", pa.int64()), ("end_ts", pa.int64()), ("n_clicks", pa.int64()), ("n_late", pa.int64()), ("cents", pa.int64())]
    + [("reason", pa.int8()), ("final", pa.bool_()), ("late", pa.bool_()), ("through", pa.bool_()), ("path", pa.string())]
)
DDL = "kind tinyint, part int, client_id bigint, id bigint, ts bigint, end_ts bigint, n_clicks bigint, n_late bigint, cents bigint, reason tinyint, final boolean, late boolean, through boolean, path string"
SESSION, PIECE, HEAD, STATE = range(4)
CLIENT, TS, LATE, ID, FINAL, CENTS = range(6)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC; a time without a zone is read as UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    minutes = F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def prepared(clicks: DataFrame, late_minutes: int, final_kind: str, final_value: float) -> DataFrame:
    """client_id, ts, late, click_id, final, cents of each click, once."""
    c = keyed(clicks, click_id="click_id", ts="ts", arrived_at="arrived_at", client_id="client_id", kind="kind", value="value")
    worth = F.col("value").cast("double")
    sound = worth.isNotNull() & ~F.isnan(worth) & (F.abs(worth) < float("inf"))
    rows = c.where("click_id is not null and client_id is not null and ts is not null").select(
        F.col("click_id").cast("long"), F.col("client_id").cast("long"), micros(c, "ts").alias("ts"),
        F.coalesce(micros(c, "arrived_at") - micros(c, "ts") > late_minutes * MINUTE, F.lit(False)).alias("late"),
        F.coalesce((F.col("kind") == final_kind) & sound & (worth >= final_value), F.lit(False)).alias("final"),
        F.when(sound, F.floor(worth * 100 + 0.5)).otherwise(0).cast("long").alias("cents"),
    )
    return rows.groupBy("click_id").agg(F.min(F.struct("ts", "client_id", "late", "final", "cents")).alias("x")).select("x.client_id", "x.ts", "x.late", "click_id", "x.final", "x.cents")


def table(kind: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of one kind; columns that aren't given are null."""
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, SCHEMA.field(k).type) for k, v in columns.items()}
    given["kind"] = pa.array(np.full(n, kind, np.int8))
    return pa.RecordBatch.from_arrays([given.get(f.name, None) if f.name in given else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def length_cuts(ts: np.ndarray, first: int, length: int) -> list[int]:
    """Where sessions start that only the length ends, in times without an end or gap, after a session that began at first."""
    out, i = [], int(np.searchsorted(ts, first + length, "right"))
    while i < len(ts):
        out.append(i)
        i = int(np.searchsorted(ts, ts[i] + length, "right"))
    return out


def joined_ids(ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """The ids from each start to the next, comma-joined."""
    s = list(map(str, ids.tolist()))
    at = [*starts.tolist(), len(s)]
    return [",".join(s[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Scan:
    """One partition: rows in order, a batch at a time."""

    def __init__(self, part: int, gap: int, length: int):
        self.part, self.gap, self.length = part, gap, length
        self.head_client, self.head_last, self.head_first = None, None, None  # while the head lasts: its last timely click, and the session that a fresh start gives
        self.in_head, self.close = True, 0
        self.open = np.zeros((6, 0), np.int64)  # rows since the last session began

    def hard(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For timely rows t but the first: 1 after an end, 2 after a gap, -1 with another client, else 0."""
        a, b = x[:, t[:-1]], x[:, t[1:]]
        return np.where(a[CLIENT] != b[CLIENT], -1, np.where(a[FINAL] > 0, 1, np.where(b[TS] - a[TS] >= self.gap, 2, 0)))

    def head(self, x: np.ndarray) -> tuple[int, pa.RecordBatch | None]:
        """How many rows at the front of x belong to the head, and these."""
        if self.head_client is None:
            self.head_client = x[CLIENT, 0]
        own = x[:, : int(np.searchsorted(x[CLIENT], self.head_client, "right"))]
        before = own if self.head_last is None else np.concatenate([self.head_last, own], 1)
        shift = before.shape[1] - own.shape[1]
        t = np.flatnonzero(before[LATE] == 0)
        cut = np.flatnonzero(self.hard(before, t)) if len(t) > 1 else []
        n = own.shape[1]
        if len(cut):
            n, self.close, self.in_head = int(t[cut[0] + 1]) - shift, int(self.hard(before, t)[cut[0]]), False
        elif n < x.shape[1]:
            self.in_head = False
        t = np.flatnonzero(own[LATE, :n] == 0)
        if len(t):
            first = t[0] if self.head_first is None else None
            if first is not None:
                self.head_first = own[:, first : first + 1]
            cuts = length_cuts(own[TS, t], int(self.head_first[TS, 0]), self.length)
            if cuts:
                self.head_first = own[:, t[cuts[-1]] : t[cuts[-1]] + 1]
            self.head_last = own[:, t[-1] : t[-1] + 1]
        h = own[:, :n]
        rows = table(HEAD, n, part=np.full(n, self.part, np.int32), client_id=h[CLIENT], id=h[ID], ts=h[TS], late=pa.array(h[LATE] > 0), final=pa.array(h[FINAL] > 0), cents=h[CENTS])
        return n, rows if n else None

    def sessions(self, x: np.ndarray, last: bool) -> pa.RecordBatch | None:
        """The sessions of x, whose first timely row starts one; the last stays open."""
        t = np.flatnonzero(x[LATE] == 0)
        if not len(t):
            self.open = x[:, :0]
            return None
        y = x[:, t]
        reason = np.concatenate([[-1], self.hard(x, t)])
        starts = np.flatnonzero(reason)
        ends = np.append(starts[1:], len(t))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if np.any(y[TS, ends - 1] - y[TS, starts] > self.length) else ():
            if y[TS, b - 1] - y[TS, a] > self.length:
                reason[a + 1 + np.array(length_cuts(y[TS, a + 1 : b], int(y[TS, a]), self.length), np.int64)] = 3
        starts = np.flatnonzero(reason)
        rows = t[starts]
        late = np.flatnonzero(x[LATE] > 0)
        of = np.searchsorted(rows, late, "right") - 1
        of = of[(of >= 0) & (x[CLIENT, rows[np.maximum(of, 0)]] == x[CLIENT, late])]
        n_late = np.bincount(of, minlength=len(starts))
        self.open = x[:, rows[-1] :]
        n = len(starts) - 1
        ends = np.append(starts[1:], len(t))
        final = y[FINAL, ends - 1]
        columns = {
            "client_id": y[CLIENT, starts], "id": y[ID, starts], "ts": y[TS, starts], "end_ts": y[TS, ends - 1], "n_clicks": ends - starts, "n_late": n_late,
            "cents": np.add.reduceat(y[CENTS], starts), "path": joined_ids(y[ID], starts),
        }
        if last:
            k = {c: v[-1:] for c, v in columns.items()}
            return table(PIECE, 1, part=[self.part], final=pa.array([bool(final[-1])]), **k)
        if not n:
            return None
        nxt = reason[starts[1:]]
        return table(SESSION, n, reason=np.where(nxt < 0, final[:n], nxt).astype(np.int8), **{c: v[:n] for c, v in columns.items()})

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("client_id", "ts", "late", "click_id", "final", "cents")])
            if not x.shape[1]:
                continue
            if self.in_head:
                n, rows = self.head(x)
                if rows is not None:
                    yield rows
                x = x[:, n:]
                if not x.shape[1]:
                    continue
            found = self.sessions(np.concatenate([self.open, x], 1), False)
            if found is not None:
                yield found
        first, last = self.head_first, self.head_last
        if not self.in_head:
            t = np.flatnonzero(self.open[LATE] == 0)
            first, last = (self.open[:, :1], self.open[:, t[-1:]]) if len(t) else (None, None)
            if len(t):
                yield self.sessions(self.open, True)
        yield state_row(self.part, self.head_client, self.in_head, self.close, first, last)


def state_row(part: int, client, through: bool, close: int, first, last) -> pa.RecordBatch:
    """A boundary state: of the head its client and how it closes, and the session that is open at the end of the partition.

    n_clicks: the head's client; client_id, id, ts: the open session's client, first click and its time; end_ts and final:
    its last click; all null where none is open.
    """
    one = lambda a, i: [None if a is None else int(a[i, 0])]
    return table(STATE, 1, part=[part], n_clicks=[None if client is None else int(client)], through=pa.array([through]), reason=[max(close, 0)], client_id=one(first, CLIENT), id=one(first, ID), ts=one(first, TS), end_ts=one(last, TS), final=pa.array([None if last is None else bool(last[FINAL, 0])]))


def head_rows(rows: pa.Table) -> np.ndarray:
    """The rows of a head, in order."""
    x = np.stack([rows.column(c).cast(pa.int64()).to_numpy() for c in ("client_id", "ts", "late", "id", "final", "cents")])
    return x[:, np.lexsort((x[ID], x[LATE], x[TS]))]


def entered(x: np.ndarray, entry: dict, gap: int, length: int) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
    """Timely rows of a head, where among them sessions start, the first start's reason (0: none) and whether one is open before."""
    t = np.flatnonzero(x[LATE] == 0)
    ts = x[TS, t]
    came = entry["client_id"] is not None and len(x[0]) and entry["client_id"] == x[CLIENT, 0]
    if not len(t):
        return t, np.zeros(0, np.int64), 0, came
    reason = 0
    if came:
        reason = 1 if entry["final"] else 2 if ts[0] - entry["end_ts"] >= gap else 3 if ts[0] - entry["ts"] > length else 0
    if came and not reason:
        starts = length_cuts(ts, entry["ts"], length)
        return t, np.array(starts, np.int64), 3, came
    return t, np.array([0, *(1 + i for i in length_cuts(ts[1:], int(ts[0]), length))], np.int64), reason, came


def exits(x: np.ndarray, entry: dict, gap: int, length: int) -> tuple:
    """The session that is open behind a head without a hard cut: client, first click, its time, last click's time and finality."""
    t, starts, _, _ = entered(x, entry, gap, length)
    if not len(t):
        return tuple(entry[c] for c in ("client_id", "id", "ts", "end_ts", "final"))
    last = int(x[TS, t[-1]]), bool(x[FINAL, t[-1]])
    if len(starts):
        s = t[starts[-1]]
        return int(x[CLIENT, s]), int(x[ID, s]), int(x[TS, s]), *last
    return entry["client_id"], entry["id"], entry["ts"], *last


def pieces(x: np.ndarray, entry: dict, part: int, close: int, gap: int, length: int) -> pa.RecordBatch | None:
    """What a head adds to the session that comes in (perhaps only why it ends), and the sessions that start in it."""
    t, starts, reason, came = entered(x, entry, gap, length)
    y = x[:, t]
    before = np.searchsorted(t, np.flatnonzero(x[LATE] > 0))  # timely rows before each late one
    n_late = np.bincount(np.searchsorted(starts, before), minlength=len(starts) + 1)
    bounds = [0, *starts.tolist(), len(t)]
    rows = []
    for k in range(0 if came else 1, len(starts) + 1):
        a, b = bounds[k], bounds[k + 1]
        of = (entry["client_id"], entry["id"], entry["ts"]) if not k else (int(y[CLIENT, a]), int(y[ID, a]), int(y[TS, a]))
        why = close if k == len(starts) else reason if not k else 3
        end = (int(y[TS, b - 1]), bool(y[FINAL, b - 1]), ",".join(map(str, y[ID, a:b].tolist()))) if b > a else (None, None, None)
        rows.append((*of, *end, b - a, int(n_late[k]), int(y[CENTS, a:b].sum()), why or None))
    if not rows:
        return None
    c = dict(zip(("client_id", "id", "ts", "end_ts", "final", "path", "n_clicks", "n_late", "cents", "reason"), zip(*rows, strict=True), strict=True))
    return table(PIECE, len(rows), part=[part] * len(rows), **{k: pa.array(v, SCHEMA.field(k).type) for k, v in c.items()})


STATE_OF = ["client_id", "id", "ts", "end_ts", "final"]


def with_entries(states: DataFrame) -> DataFrame:
    """part, head_client, through, close, the session in_* that the partition before hands on, and what was assumed (was_*)."""
    before = states.select((F.col("part") + 1).alias("part"), *[F.col(c).alias(f"in_{c}") for c in STATE_OF])
    return states.join(before, "part", "left")


def sessions(clicks: DataFrame, gap_minutes: int = 5, length_minutes: int = 120, late_minutes: int = 60, final_kind: str = "purchase", final_value: float = 60.0) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path (click ids in order, comma-joined).

    Partitions: spark.sql.shuffle.partitions many.
    """
    spark = clicks.sparkSession
    gap, length = gap_minutes * MINUTE, length_minutes * MINUTE
    rows = prepared(clicks, late_minutes, final_kind, final_value)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Scan(TaskContext.get().partitionId(), gap, length).run(batches)

    placed = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    found = stage(placed.mapInArrow(scan, DDL), "sessions", by="kind")
    heads = found.where(F.col("kind") == HEAD).select("part", "client_id", "id", "ts", "late", "final", "cents")
    states = found.where(F.col("kind") == STATE).select("part", F.col("n_clicks").alias("head_client"), "through", F.col("reason").alias("close"), *STATE_OF)
    null = [F.lit(None).cast(states.schema[c].dataType).alias(f"was_{c}") for c in STATE_OF]
    states = stage(states.select("*", *null), "states")

    def entry_of(row: dict, prefix: str) -> dict:
        return {c: row[f"{prefix}{c}"] for c in STATE_OF}

    def rerun(own: pa.Table, given: pa.Table) -> pa.Table:
        """The boundary state of a partition without a hard cut, when it is given another one than it assumed."""
        row = given.to_pylist()[0]
        entry = entry_of(row, "in_")
        out = exits(head_rows(own), entry, gap, length) if own.num_rows else tuple(entry[c] for c in STATE_OF)
        row |= dict(zip(STATE_OF, out, strict=True)) | {f"was_{c}": entry[c] for c in STATE_OF}
        return pa.Table.from_pylist([{f.name: row[f.name] for f in kind}], schema=kind)

    kind = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "tinyint": pa.int8()}[f.dataType.simpleString()]) for f in states.schema])
    differs = F.lit(False)
    for c in STATE_OF:
        differs = differs | ~F.col(f"in_{c}").eqNullSafe(F.col(f"was_{c}"))
    while True:
        told = with_entries(states).withColumn("stale", F.col("through") & differs)
        if told.where("stale").isEmpty():
            break
        stale = told.where("stale").drop("stale")
        own = heads.join(stale.select("part"), "part", "left_semi")
        again = own.groupBy("part").cogroup(stale.groupBy("part")).applyInArrow(rerun, states.schema)
        states = stage(told.where("not stale").select(*states.columns).unionByName(again), "states")

    def cut(own: pa.Table, given: pa.Table) -> pa.Table:
        row = given.to_pylist()[0]
        got = pieces(head_rows(own), entry_of(row, "in_"), row["part"], row["close"], gap, length) if own.num_rows else None
        return pa.Table.from_batches([got] if got is not None else [], SCHEMA)

    of_heads = heads.groupBy("part").cogroup(with_entries(states).groupBy("part")).applyInArrow(cut, DDL)
    return put_together(found, of_heads)


def put_together(found: DataFrame, of_heads: DataFrame) -> DataFrame:
    """Whole sessions, and those whose pieces lie in several partitions or in heads."""
    pieces_ = found.where(F.col("kind") == PIECE).select(*of_heads.columns).unionByName(of_heads)
    some = F.col("n_clicks") > 0
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("part", "path")))), lambda p: p["path"]), ",")
    # a session's first piece lies before the others; its last click decides where nothing follows
    whole = pieces_.groupBy("client_id", "id").agg(
        F.min("ts").alias("ts"), F.max("end_ts").alias("end_ts"), F.sum("n_clicks").alias("n_clicks"), F.sum("n_late").alias("n_late"), F.sum("cents").alias("cents"),
        F.coalesce(F.max("reason"), F.max_by("final", F.when(some, F.col("part"))).cast("tinyint"), F.lit(0)).alias("reason"), path.alias("path"),
    )
    both = found.where(F.col("kind") == SESSION).select(*whole.columns).unionByName(whole)
    names = F.array(*map(F.lit, REASONS))
    return both.select(
        "client_id", F.col("id").alias("session_id"), F.col("ts").alias("start_us"), F.col("end_ts").alias("end_us"), "n_clicks", "n_late",
        F.col("cents").alias("value_cents"), F.element_at(names, F.col("reason").cast("int") + 1).alias("closed_by"), "path",
    )
