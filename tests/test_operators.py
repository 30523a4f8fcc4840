"""Replays, properties and plans of the operators that SQL can't express or whose plans matter."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.functions.vectors import embed
from quillet.operators import cells, context, dedup, graph, lifecycle, mailbox, maintenance, similarity, store
from quillet.sources import snapshots
from quillet.streaming.ingest import distinct_texts, ingest

NOW = "timestamp'2025-01-15 00:00:00'"


def texts(n=120, seed=3):
    r = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            t = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(2, 14))))
    return out


@pytest.fixture(scope="module")
def embedded(spark):
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts())], "id bigint, ord bigint, text string")
    df = graph.held(rows.join(embed(rows, dims=64), "id"), "embedded")
    return df, {r.id: (r.text, np.array(r.embedding, float)) for r in df.collect()}


def keyword_sets(df):
    from quillet.functions.text import keywords

    return {r.id: set(r.k) for r in df.select("id", keywords("text").alias("k")).collect()}


def test_write_batch_replays(embedded):
    df, data = embedded
    words, stored, want = keyword_sets(df), [], {}
    for i in sorted(data):
        text, v = data[i]
        if len(text) < 10:
            want[i] = "rejected"
            continue
        best = max(((round(float(v @ data[j][1]), 6), -j) for j in stored), default=(0, 0))
        j, sim = -best[1], best[0]
        shared = len(words[i] & words[j]) / max(len(words[i] | words[j]), 1) if stored else 0
        want[i] = "added"
        if sim >= 0.55 and shared >= 0.25:
            want[i] = "skipped" if sim >= 0.84 else "flagged" if sim >= 0.72 else "added"
        if want[i] != "skipped":
            stored.append(i)
    got = {r.id: r.action for r in dedup.write_batch(df).collect()}
    assert got == want
    assert {"added", "skipped", "flagged"} <= set(got.values())


def test_write_batch_by_short_lists_and_rounds(embedded, monkeypatch):
    df, _ = embedded
    want = {r.id: r for r in dedup.write_batch(df).collect()}
    monkeypatch.setattr(dedup, "FEW_LINKS", 0)
    calls, closest = [], dedup.closest

    def counted(*args):
        found = graph.held(closest(*args), "found")
        calls.append((args[2], found.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0))
        return found

    monkeypatch.setattr(dedup, "closest", counted)
    assert {r.id: r for r in dedup.write_batch(df, listed=1).collect()} == want
    assert len(calls) > 1 and all(n <= k for k, n in calls)


def test_writing_again_adds_nothing(embedded):
    df, _ = embedded
    fates = dedup.write_batch(df)
    kept = graph.held(df.join(fates.where("action = 'added'").select("id"), "id"), "kept").limit(1000)
    shifted = kept.select((F.col("id") + 1000).alias("id"), (F.col("ord") + 1000).alias("ord"), "text", "embedding").where("length(text) > 40")
    again = dedup.write_batch(shifted, kept)
    assert {r.action for r in again.collect()} <= {"skipped"}


def test_a_stored_row_may_have_the_number_of_a_written_one(spark):
    text = "one long wooden bench stands under the old apple tree"
    rows = lambda *ids: spark.createDataFrame([(i, i, text, [1.0, 0.0]) for i in ids], "id bigint, ord bigint, text string, embedding array<float>")
    assert [(r.action, r.best_id) for r in dedup.write_batch(rows(7), rows(0)).collect()] == [("skipped", 0)]


def test_chains_of_rows_take_few_rounds(spark, monkeypatch):
    """Each row repeats the one before, so every second is kept; a last row's list is full, and what waits for it isn't known."""
    monkeypatch.setattr(dedup, "FEW_LINKS", 0)
    monkeypatch.setattr(dedup, "TASK_LINKS", 40)
    names, held = [], dedup.held
    monkeypatch.setattr(dedup, "held", lambda df, name: names.append(name) or held(df, name))
    n = 60
    links = spark.createDataFrame([(i, i - 1, 0.9, True) for i in range(1, n)] + [(n + 1, n - 1, 0.9, True), (n + 2, n + 1, 0.9, True), (n + 3, 0, 0.9, False)], "n bigint, other bigint, sim double, repeats boolean")
    todo = spark.createDataFrame([(i, None) for i in range(n + 4)], "n bigint, kept boolean")
    cut = spark.createDataFrame([(n + 1, 0.9)], "n bigint, last double")
    got = {r.n: r.kept for r in dedup.kept_rows(todo, links, cut, 0.84, None).collect()}
    assert got == {**{i: i % 2 == 0 for i in range(n)}, n: True, n + 1: None, n + 2: None, n + 3: True}
    assert names.count("state") < 4 and 2 <= names.count("followed") < 6


def test_a_next_list_is_no_longer_at_once(embedded, monkeypatch):
    df, _ = embedded
    calls, closest = [], dedup.closest
    monkeypatch.setattr(dedup, "closest", lambda *args: calls.append(args[2]) or closest(*args))
    dedup.write_batch(df, listed=1).collect()
    assert calls[:2] == [1, 1]


def test_closest_before_leaves_out_half(spark, monkeypatch):
    """Blocks are in the order of ids, so they meet those before them alone, whatever the directions are."""
    monkeypatch.setattr(cells, "LEAST_BYTES", 1)
    m = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, embedding array<float>").repartition(4)
    b = cells.blocks(v, 10, by_id=True)
    t = cells.bounds(b)
    need, half = cells.close_tiles(t, t, -9.0), cells.close_tiles(t, t, -9.0, before=True)
    assert half.count() < 0.65 * need.count()
    sim = np.round(m.astype(float) @ m.astype(float).T, 6)
    want = {(i, j) for i in range(600) for j in sorted(range(i), key=lambda j: (-sim[i, j], j))[:3] if sim[i, j] >= 1}
    assert {(r.query_id, r.id) for r in similarity.closest(v, v, 3, 1.0, True, 10).collect()} == want


def test_duplicate_sweep_multiplies_once(embedded):
    """Its near rows are written down: the plan reads them and has no products."""
    df, _ = embedded
    assert "MapInArrow" not in maintenance.duplicate_sweep(df)._jdf.queryExecution().toString()


def test_duplicate_sweep_replays(embedded):
    df, data = embedded
    ids = sorted(data)
    near = {}
    for i in ids:
        ranked = sorted(((-round(float(data[i][1] @ data[j][1]), 6), j) for j in ids if j != i))[:4]
        near[i] = [(j, -s) for s, j in ranked if -s >= 0.55]
    gone = set()
    for i in ids:
        if i in gone or len(data[i][0]) < 10:
            continue
        for j, s in near[i]:
            if j not in gone and s >= 0.84:
                gone.add(j if len(data[i][0]) >= len(data[j][0]) else i)
    assert {r.id for r in maintenance.duplicate_sweep(df).collect()} == gone
    assert gone


def test_pairs_and_knn_are_exact(spark, embedded):
    df, data = embedded
    m = np.stack([data[i][1] for i in sorted(data)])
    sim = m @ m.T
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if sim[i, j] >= 0.6}
    for block in (7, 2048):
        assert {(r.a, r.b) for r in similarity.pairs(df, 0.6, block).collect()} == want
    ties = df.unionByName(df.where("id < 10").withColumn("id", F.col("id") + 500))
    got = similarity.knn(ties.where("id = 3"), ties, 1).collect()
    first = min([j for j in range(len(m)) if j != 3 and sim[3, j] > 1 - 1e-6], default=503)
    assert [(r.id, round(r.sim, 6)) for r in got] == [(first, 1.0)]


def test_lsh_finds_most(embedded):
    df, _ = embedded
    exact = {(r.a, r.b) for r in similarity.pairs(df, 0.8).collect()}
    found = {(r.a, r.b) for r in similarity.lsh_pairs(df, 0.8).collect()}
    assert found <= exact
    assert len(found) >= 0.9 * len(exact)


def test_components_and_edges(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (3, 4), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(40)]
    g = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src bigint, dst bigint")
    got = {r.id: r.root for r in graph.components(g).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, **{100 + i: 100 for i in range(41)}}


def test_neighbours_two_hops_take_the_first_path(spark):
    e = [(1, 2, 0.9), (1, 3, 0.8), (2, 4, 0.5), (3, 4, 0.99)]
    g = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src bigint, dst bigint, weight double")
    got = graph.neighbours(g, spark.createDataFrame([(1,)], "id bigint"), 2).orderBy("rank").collect()
    assert [(r.id, r.weight) for r in got] == [(2, 0.9), (3, 0.8), (4, 0.45)]


def test_guided_search_expands(spark):
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(["red apple pie", "green apple tart", "blue sky", "dark night"])], "id bigint, ord bigint, text string")
    g = spark.createDataFrame([(0, 2, 0.8), (2, 0, 0.8)], "src bigint, dst bigint, weight double")
    members = spark.createDataFrame([(0, "cluster_0"), (2, "cluster_0")], "id bigint, cluster string")
    base = spark.createDataFrame([(0, 0.0098, 0)], "id bigint, score double, rank int")
    got = graph.guided(base, corpus, g, members, "apple", 3).collect()
    assert [(r.id, r.method, r.expanded_from, r.edge_weight) for r in got] == [(0, "graph-guided", None, None), (2, "graph-guided", 0, 0.8)]
    assert got[0].score == round(0.6 / 61 + 0.4 / 61, 4)
    assert got[1].score == round((0.6 / 61 + 0.4 / 61) * 0.8 * 0.5, 4)
    assert [r.method for r in graph.guided(base, corpus, g, members, "apple", 3, False, False).collect()] == ["global"]


def memory(spark, rows):
    return spark.createDataFrame(rows, "id string, ord bigint, text string, source string, tags array<string>, created_at timestamp, expire_at timestamp, ttl_days int")


def test_archive_and_restore_are_inverse(spark):
    rows = [(f"m{i}", i, f"text {i}", "s", ["temporary"], dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * i), None, None) for i in range(30)]
    m = memory(spark, rows)
    snap = lifecycle.split(m, F.expr(NOW))
    assert {r.state for r in snap.collect()} == {"active", "archived"}
    back = lifecycle.restore(snap, snap.where("state = 'archived'").select("id"))
    assert back.where("state = 'archived' or archived_at is not null").count() == 0
    assert back.drop("state", "archived_at").exceptAll(m).count() == 0


def test_update_delete_page(spark):
    m = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}), ("b", 2, None)], "id string, ord bigint, extra map<string,string>")
    patch = spark.createDataFrame([("a", {"y": "3", "z": "4"}, ["x"]), ("b", {"q": "5"}, None), ("zz", {}, None)], "id string, set map<string,string>, drop array<string>")
    assert {r.id: r.extra for r in store.update(m, patch).collect()} == {"a": {"y": "3", "z": "4"}, "b": {"q": "5"}}
    assert {r.id: r.extra for r in store.update(m, patch, replace=True).collect()}["a"] == {"y": "3", "z": "4"}
    assert [r.id for r in store.unknown(m, patch).collect()] == ["zz"]
    n, rest = store.delete(m, spark.createDataFrame([("a",), ("a",), ("zz",)], "id string"))
    assert (n, [r.id for r in rest.collect()]) == (2, ["b"])
    total, page = store.page(m, 1, 1)
    assert (total, [r.id for r in page.collect()]) == (2, ["b"])


def test_conflicts_keep_the_latest(spark):
    rows = [(1, 1, "月薪 3万", "ann", dt.datetime(2024, 1, 1)), (2, 2, "月薪 4万", "ann", dt.datetime(2024, 2, 1)), (3, 3, "月薪 4万", "ann", None), (4, 4, "月薪 5万", "bob", None), (5, 5, "预算 1万 预算 2万", "cy", None)]
    df = spark.createDataFrame(rows, "id bigint, ord bigint, text string, entity string, ts timestamp")
    got = maintenance.conflicts(df).collect()
    assert {(r.entity, r.attr, r["values"], r.keep, r.n_drop) for r in got} == {("ann", "salary", 2, 2, 2), ("cy", "budget", 2, 5, 0)}
    assert {r.id for r in maintenance.conflict_drops(df).collect()} == {1, 3}


def test_mailbox(spark):
    now = F.expr("timestamp'2024-01-10 00:00:00'")
    sent = mailbox.send(spark, "ann", "hi", "body", F.expr("timestamp'2024-01-09 00:00:00'"), ttl_hours=24)
    late = mailbox.broadcast(spark, "old", "body", F.expr("timestamp'2024-01-01 00:00:00'"))
    box = sent.unionByName(late)
    assert [r.subject for r in mailbox.listed(box, now).collect()] == ["hi"]
    assert box.where("box = '_global'").count() == 1
    ids = mailbox.next_unread(box, now).select("id")
    read = mailbox.marked(box, ids, "read", only="unread")
    assert sorted(r.status for r in read.collect()) == ["read", "unread"]
    assert sorted(r.status for r in mailbox.marked(read, read.select("id"), "acked").collect()) == ["acked", "acked"]
    assert mailbox.cleanup(box, now).count() == 1
    assert mailbox.removed(box, ids).count() == 1


def test_mailbox_files(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "msg_1.json").write_text(json.dumps({"id": "msg_1", "from": "bob", "subject": "s", "body": "b", "timestamp": "2024-01-01T00:00:00+00:00", "status": "unread", "ttl_hours": 72, "priority": "high", "ref": None}, indent=2))
    (tmp_path / "ann" / "msg_2.json").write_text("{not json")
    got = snapshots.read_messages(spark, str(tmp_path)).collect()
    assert [(r.id, r.box, r.sender, r.ttl_hours) for r in got] == [("msg_1", "ann", "bob", 72)]


def test_backup_round_trip(spark):
    m = memory(spark, [("m1", 1, "first text", "src", ["a"], dt.datetime(2024, 1, 1), None, 5), ("m2", 2, "  ", "", [], None, None, None), ("m3", 3, "third", "", None, None, None, None)])
    items = snapshots.export_items(m)
    got = {(r.restored_from_id, r.text, r.source) for r in snapshots.restored(items, "!").collect()}
    assert got == {("m1", "first text", "src!"), ("m3", "third", "restore!")}
    doc = snapshots.export_document(m, F.expr(NOW))
    parsed = json.loads(doc.first().value)
    assert (parsed["schema_version"], parsed["count"], [i["id"] for i in parsed["items"]]) == (1, 3, ["m1", "m2", "m3"])
    assert snapshots.document_items(doc).count() == 3


def test_snapshots(spark, tmp_path):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"), "id bigint, text string")
    assert t.read().count() == 0
    t.write(spark.createDataFrame([(1, "a")], "id bigint, text string"))
    t.append(spark.createDataFrame([(2,)], "id bigint"))
    t.write(t.read().where("id = 2"))
    assert [tuple(r) for r in t.read().collect()] == [(2, None)]


def test_context(spark):
    turns = spark.createDataFrame([(1, 1, "user", "ok"), (1, 2, "assistant", "!"), (1, 3, "user", "<memory-context>\nx</memory-context> tell me"), (1, 4, "assistant", "sure"), (1, 5, "user", "bye"), (2, 1, "assistant", "hello")], "conv_id bigint, turn bigint, role string, text string")
    assert [r.text for r in context.turn_memories(turns).collect()] == ["User: tell me\nAssistant: sure"]
    tails = {r.conv_id: r.snippet for r in context.session_tail(turns, last=2).collect()}
    assert tails == {1: "sure bye", 2: "hello"}
    rec = spark.createDataFrame([(0, 7, "fact", ["a", "b"], dt.datetime(2024, 1, 2, 12), 0.5), (1, 8, "more", [], None, 0.4)], "rank int, id bigint, text string, tags array<string>, created_at timestamp, similarity double")
    assert context.context_block(rec).first().block == "<memory-context>\n[memory] Contextual recall:\n- [a, b] fact  (2024-01-02)\n- more\n</memory-context>"
    assert context.context_block(rec.where("false")).first().block == ""
    assert json.loads(context.tool_result(rec).first().result)["count"] == 2
    assert context.facts_block(rec).first().block.endswith("- fact\n- more")
    m = spark.createDataFrame([("add", "user", "likes tea", "s1"), ("remove", "user", "x", None), ("replace", "mem", "y", "")], "action string, target string, content string, session_id string")
    assert [(r.text, len(r.tags)) for r in context.mirrored(m).orderBy("text").collect()] == [("likes tea", 3), ("y", 2)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(dt.datetime(2024, 1, 1, i), "a memory worth keeping" if i % 2 else f"another memory number {i}") for i in range(6)]
    spark.createDataFrame(rows, "ts timestamp, text string").coalesce(1).write.parquet(src)
    stream = distinct_texts(spark.readStream.schema("ts timestamp, text string").parquet(src), delay="10 hours")
    done, rebuilt = [], []
    ingest(stream, lambda b: done.extend(r.text for r in b.collect()), str(tmp_path / "ck"), None, lambda: rebuilt.append(1)).awaitTermination()
    assert sorted(done) == ["a memory worth keeping", "another memory number 0", "another memory number 2", "another memory number 4"]
    assert rebuilt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from quillet.plans import catalogue

    d = "/root/testdata/sf0.001"
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["vector_topk"](spark, d))
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["knn_batch"](spark, d))
    p = plan(catalogue.QUERIES["vector_topk_filtered"](spark, d))
    assert "EqualTo(label,3)" in p
    p = plan(catalogue.QUERIES["source_dist"](spark, d))
    assert "text" not in p.split("ReadSchema")[1]


def test_what_joins_in_components_grows_with_nodes_not_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 0)  # in rounds, as large graphs are
    written, held = {}, graph.held

    def counted(df, name):
        written.setdefault(name, (out := held(df, name)).count())
        return out

    monkeypatch.setattr(graph, "held", counted)
    n = 60
    dense = [(k * 100 + i, k * 100 + j) for k in range(3) for i in range(n) for j in range(n) if i != j]
    g = spark.createDataFrame([*dense, (900, None), (950, 950)], "src bigint, dst bigint").coalesce(2)
    got = {r.id: r.root for r in graph.components(g).collect()}
    assert got == {**{k * 100 + i: k * 100 for k in range(3) for i in range(n)}, 900: 900, 950: 950}
    assert written["graph"] <= 2 * 2 * (3 * n + 2) < len(dense)


def test_as_many_tiles_of_small_and_of_larger_tables(spark):
    tiles = []
    for n in (16_000, 64_000):
        v = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
        tiles.append(cells.bounds(cells.blocks(v, 400)).count())
    assert 6 <= tiles[0] <= 8 and 6 <= tiles[1] <= 8
