"""The facade: paths that users call, from the gate to the table."""

import json

import pytest
from pyspark.sql import functions as F

from quillet.engine import Engine
from quillet.functions import entities, text



def at(time):
    return F.expr(f"timestamp'{time}'")

BASE = "the garden behind the old house has seven apple trees and one long wooden bench"


def at(time):
    return F.expr(f"timestamp'{time}'")


def rows(spark, texts, tags=("static",)):
    return spark.createDataFrame([(t, "api", list(tags), i) for i, t in enumerate(texts)], "text string, source string, tags array<string>, place bigint")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "memory"))


def test_write_query_delete(spark, engine):
    near = BASE.replace("one long wooden bench", "two short wooden benches")
    first = {r.place: r for r in engine.write(rows(spark, [BASE, "short", "Dr. Miller paid $20 for a blue bicycle on 2024-05-01", near]), at("2024-06-01")).collect()}
    assert [first[i].action for i in range(4)] == ["added", "rejected", "added", "flagged"]
    assert first[3].best_id == first[0].id
    second = {r.place: r for r in engine.write(rows(spark, [BASE, "completely different words about mountains, rivers and distant oceans"]), at("2024-06-01")).collect()}
    assert (second[0].action, second[0].id, second[1].action) == ("skipped", first[0].id, "added")
    table = {r.id: r for r in engine.memories().collect()}
    assert len(table) == 4 and len(engine.table.current()) == 2  # the second write appended one row and rewrote nothing
    assert table[first[0].id].needs_review and table[first[0].id].review_similar_to == first[3].id
    assert table[first[3].id].needs_review and table[first[3].id].ttl_days is None
    assert table[first[2].id].ttl_days == 365
    assert {(e.text, e.label) for e in table[first[2].id].entities} == {("Dr. Miller", "person"), ("$20", "money"), ("2024-05-01", "date")}
    for k in (None, 10):
        found = engine.query("seven apple trees in the garden", retrieve_k=k).collect()
        assert [r.id for r in found[:2]] == [first[0].id, first[3].id] and found[0].text == BASE
    assert engine.guided("seven apple trees garden", at("2024-06-01")).first().id == first[0].id
    assert engine.delete(engine.memories().where("text like 'Dr.%'").select("id")) == 1
    assert engine.memories().count() == 3


def test_review_and_sweep(spark, engine):
    near = BASE.replace("one long wooden bench", "two short wooden benches")
    fates = {r.place: r for r in engine.write(rows(spark, [BASE, near, "月薪 3万 at the first company where I worked"]), at("2024-06-01")).collect()}
    engine.write(rows(spark, ["月薪 4万 since the second company hired me"]), at("2026-01-01"))
    gone = engine.nightly(at("2026-01-01")).collect()
    left = {r.text: r for r in engine.memories().collect()}
    assert len(gone) + len(left) == 4
    assert not any(t.startswith("月薪 3万") for t in left) and any(t.startswith("月薪 4万") for t in left)
    assert (BASE in left) != (near in left)  # lengths are alike, so the flagged pair counts as a duplicate
    assert fates[1].action == "flagged"


def test_review_keeps_and_clears(spark, engine):
    engine.write(rows(spark, [BASE, BASE.replace("one long wooden bench", "two short wooden benches")]), at("2024-06-01"))
    assert engine.memories().where("needs_review").count() == 2
    assert engine.nightly(at("2024-06-01"), judge=lambda a, b: F.lit("keep")).count() == 0
    assert engine.memories().where("needs_review or review_similar_to is not null or review_similarity is not null").count() == 0


def test_session_end_and_ttl(spark, engine):
    turns = spark.createDataFrame([(1, 0, "user", "where did we plant the apple trees last year"), (1, 1, "assistant", "behind the old house next to the wooden bench"), (2, 0, "user", "ok")], "conv_id bigint, turn int, role string, text string")
    done = engine.session_end(turns, at("2024-06-01")).first()
    assert (done.written, done.conflicts, done.stale, done.archived) == (1, 0, 0, 0)
    m = engine.memories().first()
    assert m.source == "session-end" and m.tags == ["session:1", "session-summary"] and m.entities is None
    engine.write(rows(spark, ["a passing note about the meeting room on the third floor"], ["temporary"]), at("2024-06-01"))
    assert engine.ttl_job(at("2026-01-01")).first().would_archive == 2
    assert engine.ttl_job(F.expr("timestamp'2024-08-01 00:00:00'"), execute=True).first().archived == 1
    assert [r.tags for r in engine.archived.read().collect()] == [["temporary"]]
    assert engine.restore_archived(engine.archived.read().select("id")) == 1
    assert (engine.memories().count(), engine.archived.read().count()) == (2, 0)


def test_restore_backup(spark, engine):
    engine.write(rows(spark, [BASE]), at("2024-06-01"))
    items = [{"id": "old1", "text": BASE, "metadata": {"source": "api", "tags": ["static"]}}, {"id": "old2", "text": "mountains and rivers and distant oceans far away", "metadata": {}}, {"id": "old3", "text": " \t\n", "metadata": {}}, {"id": "old4", "text": "tiny", "metadata": {}}]
    backup = spark.createDataFrame([(json.dumps(x),) for x in items], "value string")
    got = {r.restored_from_id: r for r in engine.restore_backup(backup, at("2026-01-01"), ":again").collect()}
    assert {k: v.action for k, v in got.items()} == {"old1": "skipped", "old2": "added", "old4": "rejected"}
    table = {r.id: r for r in engine.memories().collect()}
    assert len(table) == 2
    assert {r.extra["restored_from_id"] for r in table.values()} == {"old1", "old2"}
    assert table[got["old2"].id].source == "restore:again" and table[got["old2"].id].extra["restored_at"] == "2026-01-01T00:00:00"


def test_graph_cache_is_used_for_a_day(spark, engine):
    engine.write(rows(spark, [BASE, "completely different words about mountains, rivers and distant oceans"]), at("2024-06-01"))
    v = engine.vectors().select("id", "ord", "embedding")
    engine.cache.load(v, at("2024-06-01"))
    assert engine.cache.fresh(F.expr("timestamp'2024-06-01 23:00:00'")) is not None
    assert engine.cache.fresh(F.expr("timestamp'2024-06-02 01:00:00'")) is None
    assert engine.cache.fresh(at("2024-06-01"), threshold=0.9) is None


def test_entities_and_segmenter(spark):
    df = spark.createDataFrame([("Ms. Lee of Acme Corp moved to Oslo",), (None,), ("nothing",)], "text string")
    got = [[(e.text, e.label) for e in r.e] for r in df.select(entities.extract("text", words={"location": ["Oslo"]}).alias("e")).collect()]
    assert got == [[("Ms. Lee", "person"), ("Oslo", "location"), ("Acme Corp", "organization")], [], []]
    kept = df.withColumn("entities", F.expr("array(named_struct('text', 'x', 'label', 'event'))"))
    assert [[e.text for e in r.entities] for r in entities.enriched(kept).collect()] == [["Ms. Lee", "Acme Corp"], ["x"], ["x"]]
    assert df.where("text is not null").select(text.keywords("text", lambda t: F.split(t, " ")).alias("k")).first().k[:3] == ["ms.", "lee", "of"]


def test_queries_by_the_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "indexed"))
    word = lambda i, k: "".join(chr(97 + (i * (j + 2) + k * (j + 5) + j) % 26) for j in range(6))
    rows = lambda a, b: spark.createDataFrame([(" ".join([*(word(i, k) for k in range(5)), "violin"]), "s", [], i) for i in range(a, b)], "text string, source string, tags array<string>, place bigint")
    now = F.expr("timestamp'2025-01-15 00:00:00'")
    with pytest.raises(ValueError, match="no index"):
        e.query("violin", probes=2)
    e.write(rows(0, 30), now, extract=False)
    index = e.build_index(n_cells=4)
    whole = [tuple(r) for r in e.query("violin keeps", 5, 0.1).collect()]
    assert [tuple(r) for r in e.query("violin keeps", 5, 0.1, probes=len(index.centres)).collect()] == whole
    e.write(rows(30, 36), now, extract=False)
    text = rows(33, 34).first().text
    found = e.query(text, 1, 0.1, probes=len(index.centres)).first()
    assert found.text == e.query(text, 1, 0.1).first().text == text
    e.delete(spark.createDataFrame([(found.id,)], "id string"))
    assert found.id not in [r.id for r in e.query(text, 3, 0.1, probes=len(index.centres)).collect()]
