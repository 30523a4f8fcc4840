"""The learnt embedder against numpy's decomposition."""

import random

import numpy as np
import pytest

from quillet.engine import Engine
from quillet.functions import projection
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts(spark):
    """Texts of a few topics, nulls, empty ones and copies."""
    r = random.Random(6)
    topics = [["".join(r.choices("abcdefgh", k=5)) for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(r.choices(topics[i % 6], k=25) + r.choices(topics[(i + 1) % 6], k=3))) for i in range(240)]
    rows += [(240, None), (241, ""), (242, rows[0][1])]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(5).cache()


def dense(texts, weight):
    rows = projection.bucketed(texts, len(weight)).orderBy("id").collect()
    a = np.zeros((len(rows), len(weight)))
    for i, r in enumerate(rows):
        np.add.at(a[i], r.buckets, 1)
    a *= weight
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1)


def test_it_is_the_decomposition(spark, texts, tmp_path):
    p = projection.Projection.learn(texts, dims=5, buckets=512, rounds=8)
    a = dense(texts, p.weight)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(p.values, s[:5], rtol=1e-3)
    assert np.allclose(np.linalg.svd(p.basis.T @ v[:5].T)[1], 1, atol=1e-3)  # the same subspace
    p.save(spark, str(tmp_path / "p"))
    again = projection.Projection.load(spark, str(tmp_path / "p"))
    got = {r.id: np.array(r.embedding) for r in again.embed(texts).collect()}
    want = a @ p.basis
    for i in range(243):
        n = np.linalg.norm(want[i])
        assert np.allclose(got[i], want[i] / n if n > 1e-12 else want[i], atol=1e-5)
    assert not got[240].any() and not got[241].any() and np.allclose(got[242], got[0])


def test_topics_are_near(texts):
    p = projection.Projection.learn(texts, dims=6, buckets=2048)
    m = {r.id: np.array(r.embedding) for r in p.embed(texts).collect()}
    r = random.Random(1)
    same = [m[i] @ m[i + 6 * r.randint(1, 20)] for i in range(100)]
    other = [m[i] @ m[i + 3] for i in range(100)]
    assert np.mean(same) > 0.8 and np.mean(other) < 0.4


def test_an_engine_with_it(spark, texts, tmp_path):
    p = projection.Projection.learn(texts, dims=6, buckets=2048)
    engine = Engine(spark, str(tmp_path / "e"), embedder=p.embed)
    rows = texts.where("id < 30").select("text", F.lit("s").alias("source"), F.array().cast("array<string>").alias("tags"), F.col("id").alias("place"))
    engine.write(rows, F.expr("timestamp'2025-01-15 00:00:00'"), extract=False)
    text = texts.where("id = 0").first().text
    assert engine.query(text, top_k=1).first().text == text


def test_counted_texts_are_learnt_and_embedded_as_texts_are(texts):
    """What was tokenised once serves learn() and embed(); dense and sparse products agree."""
    once = projection.counted(texts, 512).cache()
    a = projection.Projection.learn(texts, dims=5, buckets=512, rounds=3)
    b = projection.Projection.learn(once, dims=5, buckets=512, rounds=3)
    assert np.allclose(a.weight, b.weight) and np.allclose(a.values, b.values)
    x, y = ({r.id: np.array(r.embedding) for r in p.embed(t).collect()} for p, t in ((a, texts), (b, once)))
    assert x.keys() == y.keys() and all(np.allclose(x[i], y[i], atol=1e-5) for i in x)
    r = np.random.default_rng(2)
    m = np.where(r.random((40, 90)) < 0.2, r.normal(size=(40, 90)), 0)
    m[3] = 0
    block = r.normal(size=(90, 6))
    row, bucket = np.nonzero(m)
    was = projection.DENSE
    for projection.DENSE in (1, 64):
        assert (projection.dense(row, bucket, m[row, bucket], 40, 90) is None) == (projection.DENSE == 1)
        assert np.allclose(projection.there_and_back(row, bucket, m[row, bucket], block, 40), m.T @ (m @ block))
    projection.DENSE = was
