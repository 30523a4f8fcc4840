"""Components kept up through additions and removals, against a whole solution each time."""

import random

import pytest
from pyspark.sql import functions as F

from quillet.operators import changes, graph
from quillet.sources.held import held


def solved(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src bigint, dst bigint")


def both(edges):
    return {(a, b) for x, y in edges for a, b in ((x, y), (y, x))}


@pytest.mark.parametrize("seed", [1, 2])
def test_ten_changes(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(graph, "FEW_EDGES", 0)  # in rounds, as large graphs are
    r = random.Random(seed)
    pick = lambda n, k: {tuple(sorted(r.sample(range(n), 2))) for _ in range(k)}
    edges = pick(300, 120)
    labels = held(graph.components(frame(spark, both(edges))), "labels")
    for step in range(4):
        gone = set(r.sample(sorted(edges), 6)) if step % 2 else set()
        came = pick(340, 8) - edges
        labels, touched = changes.updated(labels, frame(spark, both(edges)), frame(spark, came) if came else None, frame(spark, gone) if gone else None)
        labels = held(labels, "labels")
        edges = (edges - gone) | came
        assert {x.id: x.root for x in labels.collect()} == solved(edges)
        assert touched < 340


def test_work_is_the_changes(spark):
    """A change in a small component leaves a large one alone."""
    large = {(i, i + 1) for i in range(1000, 1400)}
    small = {(1, 2), (2, 3), (5, 6)}
    labels = held(graph.components(frame(spark, both(large | small))), "labels")
    got, touched = changes.updated(labels, frame(spark, both(large | small)), frame(spark, {(3, 5)}), frame(spark, {(1, 2)}))
    assert touched <= 8
    assert {x.id: x.root for x in got.collect()} == solved((large | small | {(3, 5)}) - {(1, 2)})


def test_cache_update(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, i, [r.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    v = spark.createDataFrame([(i, o, [x / sum(y * y for y in e) ** 0.5 for x in e]) for i, o, e in rows], "id bigint, ord bigint, embedding array<float>").cache()
    at = lambda h: F.expr(f"timestamp'2025-01-15 00:00:00' + interval {h} hours")
    cache, whole = graph.GraphCache(spark, str(tmp_path / "a")), graph.GraphCache(spark, str(tmp_path / "b"))
    cache.write(v.where("id < 60"), at(0), 0.9)
    after = v.where("id % 9 <> 0")
    cache.update(after, at(1), after.where("id >= 60").select("id"), v.where("id % 9 = 0").select("id"), 0.9)
    whole.write(after, at(1), 0.9)
    for got, want in zip(cache.fresh(at(2), 0.9), whole.fresh(at(2), 0.9), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cache.update(after, at(3), after.where("false").select("id"), after.where("false").select("id"), 0.9) == 0
