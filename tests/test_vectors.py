"""Blocks of cells, exact joins with bounds, and the index of vectors."""

import re

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quillet.operators import cells, similarity


def frame(spark, m, parts=4):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m.astype(np.float32))]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(parts)


def clustered(n=600, dims=16, groups=12, spread=0.15, seed=3):
    """Unit vectors around a few directions, with a third of all rows equal."""
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, dims))
    m = c[r.integers(0, groups, n)] / np.sqrt(dims) + spread * r.normal(size=(n, dims)) / np.sqrt(dims)
    m = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    m[n // 3 : 2 * n // 3] = m[0]
    return m


def scattered(n=300, dims=8, seed=4):
    """Vectors of all directions and lengths, zeros too."""
    m = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    m[::50] = 0
    return m


def products(m):
    m = m.astype(np.float64)
    return m @ m.T


@pytest.mark.parametrize("make,threshold", [(clustered, 0.9), (clustered, 0.5), (scattered, 5.0), (scattered, -1.0)])
def test_pairs_with_bounds(spark, make, threshold):
    m = make()
    sim = products(m)
    want = {(i, j) for i, j in np.argwhere(sim >= threshold).tolist() if i < j}
    got = similarity.pairs(frame(spark, m), threshold, block=16).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.sim - sim[r.a, r.b]) < 1e-9 for r in got)


def test_bounds_leave_out_most_pairs_of_blocks(spark):
    x = similarity.pruning(frame(spark, clustered(1500, 16, 40, 0.1)), 0.9, block=16).first()
    assert 0 < x.multiplied < x.block_pairs / 5


def by_hand(m, q, k, threshold):
    sim = np.round(products(m)[q], 6)
    out = set()
    for a, i in enumerate(q):
        order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-sim[a, j], j))[:k]
        out |= {(i, j, n) for n, j in enumerate(order) if sim[a, j] >= threshold}
    return out


@pytest.mark.parametrize("make,threshold", [(clustered, 0.0), (clustered, 0.8), (scattered, -100.0)])
@pytest.mark.parametrize("block", [16, 4096])
def test_knn_with_bounds(spark, make, threshold, block):
    m = make()
    v = frame(spark, m)
    got = similarity.knn(v.where("id % 20 = 0"), v, 5, threshold, block).collect()
    assert {(r.query_id, r.id, r.rank) for r in got} == by_hand(m, list(range(0, len(m), 20)), 5, threshold)


def test_cross_with_bounds(spark):
    m = clustered()
    v, sim = frame(spark, m), products(m)
    got = {(r.a, r.b) for r in similarity.cross(v.where("id % 10 = 1"), v, 0.7, block=16).collect()}
    assert got == {(i, j) for i, j in np.argwhere(sim >= 0.7).tolist() if i % 10 == 1}


def test_blocks_move_by_tiles(spark, monkeypatch):
    """A block goes to each pair of tiles once, however many blocks it meets there; results stay exact over tiles."""
    monkeypatch.setattr(cells, "LEAST_BYTES", 1)
    monkeypatch.setattr(cells, "TILES", 4)
    m = scattered(640)
    b = cells.blocks(frame(spark, m), 10)
    tiles = cells.bounds(b)
    n, need = tiles.count(), cells.close_tiles(tiles, tiles, -100.0, True)
    assert 2 <= n <= 6 and b.count() >= 64
    assert need.count() == (n + 1) * b.count() < cells.close_pairs(b, b, -100.0, True).count() / 4
    sim = products(m)
    got = {(r.a, r.b) for r in similarity.pairs(frame(spark, m), 6.0, block=10).collect()}
    assert got == {(i, j) for i, j in np.argwhere(sim >= 6.0).tolist() if i < j}
    v = frame(spark, m)
    knn = similarity.knn(v.where("id % 20 = 0"), v, 5, -100.0, 10).collect()
    assert {(r.query_id, r.id, r.rank) for r in knn} == by_hand(m, list(range(0, len(m), 20)), 5, -100.0)


def test_no_cartesian_product(spark):
    v = frame(spark, clustered())
    for df in (similarity.pairs(v, 0.9, 16), similarity.knn(v.where("id < 50"), v, 3, 0.0, 16), similarity.cross(v, v, 0.9, 16)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block", [2, 4096])
def test_odd_vectors(spark, block):
    kind = "id bigint, embedding array<float>"
    assert similarity.pairs(spark.createDataFrame([], kind), 0.5, block).collect() == []
    assert similarity.knn(spark.createDataFrame([], kind), spark.createDataFrame([], kind), 3, 0.0, block).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], kind)
    assert [(r.a, r.b) for r in similarity.pairs(one, 0.5, block).collect()] == [(1, 3)]
    uneven = spark.createDataFrame([(i, [1.0] * (2 + i % 2)) for i in range(20)], kind)
    with pytest.raises((ValueError, PythonException), match="all must have as many"):
        similarity.pairs(uneven, 0.5, block).collect()


def test_centres_are_the_same_again(spark):
    v = frame(spark, clustered())
    a, b = cells.learn_centres(v, 12), cells.learn_centres(v.repartition(7), 12)
    assert a.shape == b.shape and np.abs(a - b).max() < 1e-9
    assert np.allclose(np.linalg.norm(a, axis=1), 1)


# -- the index -----------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    from quillet.operators.vector_index import VectorIndex

    v = frame(spark, clustered(3000, 32, 60, 0.6)).cache()
    path = str(tmp_path_factory.mktemp("index") / "i")
    VectorIndex.build(v.where("id < 2500"), path)
    opened = VectorIndex(spark, path)
    opened.append(v.where("id >= 2500"))
    return opened, v


def recall(found, exact):
    """The share of exact rows' similarities that are reached; among equal vectors any will do."""
    got, want = ({}, {})
    for rows, to in ((found, got), (exact, want)):
        for r in rows.collect():
            to.setdefault(r.query_id, []).append(r.sim)
    hits = sum(sum(s >= min(want[q]) - 1e-6 for s in got.get(q, [])) for q in want)
    return hits / sum(map(len, want.values()))


def test_index_recall_and_share(spark, index):
    i, v = index
    q = v.where("id % 20 = 0")
    exact = similarity.knn(q, v, 10)
    assert recall(i.search(q, 10, probes=6, refine=80), exact) >= 0.9
    assert i.share(q, 6) < 0.5 and i.share(q, 2) < i.share(q, 6)
    all_cells = len(i.centres)
    assert i.share(q, all_cells) == pytest.approx(1)


def test_index_holds_every_row(spark, index):
    i, v = index
    listed = i.lists().select(F.explode("ids").alias("id"))
    assert sorted(r.id for r in listed.collect()) == list(range(3000))
    q = v.where("id in (5, 7, 2900)")
    whole = i.search(q, 10, probes=len(i.centres), refine=3000)
    want = {(r.query_id, r.id, r.rank) for r in similarity.knn(q, v, 10, -9.0).collect()}
    assert {(r.query_id, r.id, r.rank) for r in i.search(q, 10, len(i.centres), 3000, -9.0).collect()} == want and whole.count() == 30


def test_index_reads_probed_cells_only(spark, index):
    i, v = index
    vector = [float(x) for x in v.where("id = 7").first().embedding]
    df = i.topk(vector, 5, 0.2, probes=3)
    plan = df._jdf.queryExecution().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN ", plan)) >= 2
    exact = similarity.topk(v, vector, 5, 0.2)
    assert df.first().similarity == exact.first().similarity


def test_index_of_nothing(spark, tmp_path):
    from quillet.operators.vector_index import VectorIndex

    with pytest.raises(ValueError, match="needs a vector"):
        VectorIndex.build(spark.createDataFrame([], "id bigint, embedding array<float>"), str(tmp_path / "x"))
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id bigint, embedding array<float>"), str(tmp_path / "y"))
    assert [r.id for r in one.topk([1.0, 0.0], 5, -1.0).collect()] == [1, 3]


def test_index_is_calibrated_to_its_recall(spark, tmp_path):
    from quillet.operators.vector_index import VectorIndex

    v = frame(spark, np.random.default_rng(5).normal(size=(6000, 48))).cache()
    i = VectorIndex.build(v, str(tmp_path / "i"))
    q = v.where("id % 20 = 0")
    exact, some = similarity.knn(q, v, 5, -9.0), len(i.centres) // 2
    assert recall(i.search(q, 5, some, 40, -9.0), exact) < 0.85
    probes, refine = i.calibrated(v, 5, some, 40)
    assert probes > some and refine > 40 and recall(i.search(q, 5, probes, refine, -9.0), exact) >= 0.9


def test_index_finds_equal_vectors_by_their_ids(spark, tmp_path):
    from quillet.operators.vector_index import VectorIndex

    m = clustered(300, 16, 10, 0.6)
    m[::2] = m[0]
    v = frame(spark, m).cache()
    i = VectorIndex.build(v, str(tmp_path / "i"))
    got = i.search(v.where("id in (0, 40, 298)"), 3, len(i.centres), 5)
    assert {r.query_id: [x.id for x in got.orderBy("rank").collect() if x.query_id == r.query_id] for r in got.collect()} == {0: [2, 4, 6], 40: [0, 2, 4], 298: [0, 2, 4]}


def test_index_moves_lists_to_packs_of_queries(spark, index, monkeypatch):
    """Not a row for each query and cell that it probes; results are those of all candidates, whatever the tasks are."""
    from quillet.operators import vector_index

    i, v = index
    q, n = v.where("id % 10 = 0").cache(), len(i.centres)
    asked, packs, parts = i.packed(q, n, 100)
    assert packs > 1 and i.met(asked, packs, parts, i.coded(None)).count() == packs * (parts + i.lists().count()) < q.count() * n / 10
    want = {(r.query_id, r.id, r.rank) for r in similarity.knn(q, v, 4, -9.0).collect()}
    for tasks in (1, 7):
        monkeypatch.setattr(vector_index, "TASKS", tasks)
        assert {(r.query_id, r.id, r.rank) for r in i.search(q, 4, n, 3000, -9.0).collect()} == want
    near = i.candidates(q, n, 30).where("query_id <> id").select("query_id", "id")
    few = i.search(q, 4, n, 29, -9.0).join(near, ["query_id", "id"], "left_semi").count()
    assert few >= 0.99 * 4 * q.count()


def test_the_closest_by_floats_are_those_by_doubles():
    """hopeful() and the exact products of what it leaves, with equal rows, ties, own rows and a least similarity."""
    r = np.random.default_rng(5)
    m = r.normal(size=(3000, 24)).astype(np.float32)
    m[1000:1040], m[5] = m[7], 0
    ids = r.permutation(3000)
    q, qi = m[:600], ids[:600]
    for k, before, threshold in ((3, False, -np.inf), (3, True, -np.inf), (5, False, 9.0), (4, True, 2.0)):
        best = similarity.best_of(k, before, threshold)
        for least in (None, np.where(np.arange(600) % 2, 12.5, -np.inf)):
            assert similarity.hopeful(qi, q, ids, m, k, before, np.full(600, threshold)) is not None
            got = best(qi, q, ids, m, False, least)
            want = best(qi, q.astype(np.float64), ids, m.astype(np.float64), False, least)
            assert sorted(zip(*(x.tolist() for x in got[:2]), strict=True)) == sorted(zip(*(x.tolist() for x in want[:2]), strict=True))
            assert len(got[0]) > 300
    assert similarity.hopeful(qi, q, ids, np.zeros_like(m), 3, False, np.full(600, -np.inf)) is None  # all are equal
    halves = [best(qi, q, ids[x], m[x], False) for x in (slice(0, 1500), slice(1500, 3000))]
    merged = best.merge(*(np.concatenate(x) for x in zip(*halves, strict=True)))
    whole = best(qi, q, ids, m, False)
    assert sorted(zip(*(x.tolist() for x in merged[:2]), strict=True)) == sorted(zip(*(x.tolist() for x in whole[:2]), strict=True))


def test_a_strip_brings_k_rows_a_tile(spark):
    """What a task finds in the chunks of a tile is merged before it leaves: 3 rows a query, not 3 a chunk."""
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(9000, 4)).astype(np.float32))]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    b = cells.blocks(v.repartitionByRange(1, "id").sortWithinPartitions("id"), 500)
    q = cells.blocks(v.where("id < 100"), 500)
    m, n = cells.bounds(b), cells.bounds(q)
    found = cells.multiplied(cells.close_tiles(n, m, -9.0), q, b, similarity.best_of(3), similarity.FOUND, n.count() * m.count())
    assert m.count() < 9000 // cells.CHUNK + 1 and found.count() == 300 * m.count() * n.count()
