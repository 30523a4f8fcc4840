"""Streams: exactly once through restarts, timers, windows and late rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillet.engine import Engine
from quillet.functions.vectors import embed
from quillet.sources.snapshots import Snapshots
from quillet.streaming import ingest, timers

ROWS = "text string, source string, tags array<string>, place bigint, ts timestamp"


def put(spark, folder, rows, schema, name):
    """One more file for a stream to find."""
    df = spark.createDataFrame(rows, schema)
    df.select(*[F.col(c).cast("timestamp") if t == "timestamp" else F.col(c) for c, t in df.dtypes]).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def texts(start, n):
    """Rows without a word in common."""
    word = lambda i, k: "".join("bcdfghklmnprstvz"[(i * 31 + k * 7 + j * 5 + (i * k) % 11) % 16] + "aeiou"[(i + k * 3 + j) % 5] for j in range(4)) + "abcdefghijklmnopqrstuvwxyz"[i % 26]
    return [(" ".join(word(i, k) for k in range(8)), "chat", ["static"], i, None) for i in range(start, start + n)]


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_killed_batch_is_written_once(spark, tmp_path, monkeypatch, where):
    """The writer dies before or after the snapshot's pointer is set; the restarted stream replays the batch."""
    folder, engine = tmp_path / "in", Engine(spark, str(tmp_path / "table"), embedder=lambda t: embed(t, dims=2048, idf=False))
    at = F.expr("timestamp'2025-01-15 00:00:00'")
    put(spark, folder, texts(0, 5), ROWS, "a")

    def run():
        ingest.into_engine(read(spark, folder, ROWS), engine, str(tmp_path / "checkpoint"), "s", now=at, every=None, extract=False).awaitTermination()

    run()
    real, calls = Snapshots._write, []

    def dies(self, df, keep, mark):
        if where == "after":
            real(self, df, keep, mark)
        calls.append(mark)
        raise RuntimeError("killed")

    put(spark, folder, [*texts(5, 5), ("ok", "chat", [], 99, None), texts(2, 1)[0]], ROWS, "b")
    monkeypatch.setattr(Snapshots, "_write", dies)
    with pytest.raises(Exception):  # noqa: B017
        run()
    assert calls == [("s", 1)]
    monkeypatch.setattr(Snapshots, "_write", real)
    run()
    run()
    found = [r.text for r in engine.memories().orderBy("ord").collect()]
    assert found == [t for t, *_ in texts(0, 10)]  # the short text and the repeated one are not there
    assert engine.table.written(("s", 1)) and not engine.table.written(("s", 2))


def test_pointers_that_are_not_whole(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), "id string, ord bigint")
    rows = spark.createDataFrame([("a", 1)], "id string, ord bigint")
    t.append(rows, mark=("x", 4))
    (tmp_path / "t" / "pointers" / "000000001").write_text("")
    (tmp_path / "t" / "pointers" / "000000002").write_text('{"folders": ["v')
    assert [r.id for r in t.read().collect()] == ["a"] and t.written(("x", 4)) and not t.written(("x", 5)) and not t.written(("y", 0))
    t.append(rows, mark=("x", 3))
    assert t.read().count() == 1
    t.append(rows, mark=("x", 5))
    t.done(("x", 6))
    assert t.read().count() == 2 and t.written(("x", 6)) and len(os.listdir(tmp_path / "t" / "pointers")) >= 5


def test_archive_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "table"), embedder=lambda t: embed(t, dims=2048, idf=False))
    engine.write(spark.createDataFrame(texts(0, 4), ROWS).drop("ts"), F.expr("timestamp'2020-01-01 00:00:00'"), extract=False)
    now, real = F.expr("timestamp'2025-01-15 00:00:00'"), Snapshots.write
    monkeypatch.setattr(Snapshots, "write", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        engine.archive(now)
    monkeypatch.setattr(Snapshots, "write", real)
    assert engine.archive(now) == 4
    assert engine.memories().count() == 0 and engine.archived.read().count() == 4


MESSAGES = "id bigint, box bigint, ts timestamp, status string, ttl_hours int"


def at(spark, rows):
    """Times as hours since 2024-01-01."""
    return [(i, b, f"2024-01-01 00:00:00 +{h}", s, ttl) for i, b, h, s, ttl in rows]


def files(spark, folder, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id bigint, box bigint, h double, status string, ttl_hours int")
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("h") * 3600)).select("id", "box", "ts", "status", "ttl_hours")
        df.coalesce(1).write.parquet(f"{folder}/b{k}")
        yield


def run_all(spark, tmp_path, batches, how, schema):
    """Each batch is one start of the stream on the same checkpoint; what came out after each."""
    seen = []
    for _ in files(spark, tmp_path / "in", batches):
        stream = how(read(spark, tmp_path / "in", MESSAGES))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    return seen


def test_expiry_at_each_watermark(spark, tmp_path):
    batches = [
        [(1, 7, 0.0, "unread", 2), (2, 7, 1.0, "read", 10), (3, None, 1.5, "unread", 1), (None, 1, 1.0, "x", 1), (4, 1, None, "x", 1), (5, 1, 1.0, "x", None)],
        [(6, 8, 3.9, "unread", 1), (2, 7, 2.0, "acked", 3)],  # a later row of 2 brings its expiry forward
        [(7, 8, 9.0, "unread", 100)],
    ]
    seen = run_all(spark, tmp_path, batches, lambda s: timers.expired_messages(s, "1 hour"), "id bigint, box bigint, status string, expires_ms bigint")
    hours = lambda rows: sorted((r.id, r.box, r.status, (r.expires_ms / 1000 - 1_704_067_200) / 3600) for r in rows)
    # watermarks: 0.5, 2.9, 8 hours
    assert hours(seen[0]) == []
    assert hours(seen[1]) == [(1, 7, "unread", 2.0), (3, None, "unread", 2.5)]
    assert hours(seen[2]) == [(1, 7, "unread", 2.0), (2, 7, "acked", 5.0), (3, None, "unread", 2.5), (6, 8, "unread", 4.9)]


def test_messages_expire_from_shared_state(spark, tmp_path, monkeypatch):
    """Several messages of one group of state: one that moves, one that goes, and each expires once."""
    monkeypatch.setattr(timers, "GROUPS", 1)
    batches = [
        [(1, 7, 0.0, "a", 5), (2, None, 0.1, "b", 1), (3, 9, 0.2, None, 2), (1, 7, 0.3, "c", 1)],
        [(3, 9, 0.5, "gone", 1), (4, 9, 2.5, "d", 1)],
        [(5, 9, 9.0, "e", 1)],
    ]
    how = lambda s: timers.expired_messages(s, "1 hour", gone=F.col("status") == "gone")
    seen = run_all(spark, tmp_path, batches, how, "id bigint, box bigint, status string, expires_ms bigint")
    hours = lambda rows: sorted((r.id, r.box, r.status, round((r.expires_ms / 1000 - 1_704_067_200) / 3600, 2)) for r in rows)
    assert hours(seen[0]) == []
    assert hours(seen[1]) == [(1, 7, "c", 1.3), (2, None, "b", 1.1)]
    assert hours(seen[2]) == [(1, 7, "c", 1.3), (2, None, "b", 1.1), (4, 9, "d", 3.5)]


def test_one_rebuild_for_many_changes(spark, tmp_path):
    batches = [[(1, 1, 0.0, "a", 1), (2, 1, 0.5, "a", 1), (3, 1, 0.2, "b", 1)], [(4, 1, 0.9, "a", 1), (5, 1, 2.5, "b", 1)], [(6, 1, 2.6, "a", 1), (7, 1, 9.0, "c", 1)]]
    how = lambda s: timers.rebuilds(s.select(F.col("status").alias("name"), "ts"), 3_600_000)
    seen = run_all(spark, tmp_path, batches, how, "name string, first_ms bigint, due_ms bigint, changes bigint")
    short = lambda rows: sorted((r.name, round((r.first_ms / 1000 - 1_704_067_200) / 3600, 2), r.changes) for r in rows)
    assert short(seen[0]) == []
    assert short(seen[1]) == [("a", 0.0, 3), ("b", 0.2, 1)]
    assert short(seen[2]) == [("a", 0.0, 3), ("a", 2.6, 1), ("b", 0.2, 1), ("b", 2.5, 1)]


def test_sessions_merge_and_late_rows_drop(spark, tmp_path):
    batches = [
        [(1, 7, 0.0, "a", 1), (2, 7, 0.8, "a", 1), (3, 8, 1.2, "a", 1)],  # 7: two sessions so far
        [(4, 7, 0.4, "a", 1), (5, 8, 4.0, "a", 1)],  # 4 closes the gap between them
        [(6, 7, 0.9, "a", 1), (7, 8, 9.0, "a", 1)],  # 6 comes after the watermark has passed its session
        [(8, 9, 20.0, "a", 1)],
    ]
    seen = run_all(spark, tmp_path, batches, lambda s: ingest.activity(s, "30 minutes", "1 hour"), "box bigint, first_ts timestamp, ends_at timestamp, n bigint")
    assert sorted((r.box, r.n) for r in seen[-1]) == [(7, 3), (8, 1), (8, 1), (8, 1)]


def test_sliding_windows(spark, tmp_path):
    batches = [[(1, 7, 0.5, "a", 1), (2, 7, 1.5, "a", 1)], [(3, 7, 6.0, "b", 1)]]
    seen = run_all(spark, tmp_path, batches, lambda s: ingest.counts(s, "2 hours", "1 hour", "1 hour"), "window_start timestamp, window_end timestamp, status string, n bigint")
    assert sorted((r.window_end.hour, r.n) for r in seen[-1]) == [(1, 1), (2, 2), (3, 1)]
