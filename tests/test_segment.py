"""The segmenter against all cuts of short runs, and words that it learns."""

import itertools
import math
import random

import pytest

from quillet.functions import segment
from quillet.functions.text import keywords


def cuts(run, longest):
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            parts = [run[a:b] for a, b in itertools.pairwise((0, *at, len(run)))]
            if all(len(p) <= longest for p in parts):
                yield parts


def score(parts, words):
    return sum(words.get(p, segment.UNKNOWN if len(p) == 1 else -math.inf) for p in parts)


@pytest.mark.parametrize("seed", range(5))
def test_best_path_and_expectations_of_all_cuts(seed):
    r = random.Random(seed)
    words = {"".join(r.choices("天地人", k=r.randint(1, 3))): math.log(r.uniform(0.01, 0.5)) for _ in range(8)}
    for _ in range(30):
        run = "".join(r.choices("天地人x", k=r.randint(1, 8)))
        every = list(cuts(run, 3))
        best = max(score(c, words) for c in every)
        assert score(segment.best_path(run, words, 3), words) == pytest.approx(best)
        weights = [math.exp(score(c, words)) for c in every]
        want: dict[str, float] = {}
        for c, w in zip(every, weights, strict=True):
            for p in c:
                want[p] = want.get(p, 0.0) + w / sum(weights)
        got = segment.expected(run, words, 3)
        assert all(got.get(p, 0.0) == pytest.approx(e, abs=1e-9) for p, e in want.items())


def test_long_runs():
    words = {"天": -1.0, "天天": -2.5}
    assert "".join(segment.best_path("天" * 5000, words, 4)) == "天" * 5000
    assert sum(len(w) * e for w, e in segment.expected("天" * 3000, words, 4).items()) == pytest.approx(3000)


def test_words_are_learnt(spark):
    r = random.Random(3)
    vocab = ["苹果", "香蕉", "水", "图书馆", "学生", "今天", "喜欢", "老师", "在", "去"]
    rows = [(i, f"User {i} " + "".join(r.choices(vocab, k=r.randint(3, 9))) + "。 ok") for i in range(400)] + [(500, None), (501, ""), (502, "no runs 12")]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    s = segment.Segmenter.learn(texts, rounds=6)
    true = [r.choices(vocab, k=6) for _ in range(50)]
    right = sum(s.cut("".join(t)) == t for t in true)
    assert right >= 45
    got = {x.id: x.k for x in texts.select("id", keywords("text", s).alias("k")).collect()}
    assert got[500] is None and got[501] == [] and got[502] == ["runs", "12"]
    assert sum(set(k) - {"user", str(i)} <= set(vocab) for i, k in got.items() if i < 400) >= 340


def test_a_corpus_without_runs(spark):
    s = segment.Segmenter.learn(spark.createDataFrame([(1, "abc")], "id bigint, text string"))
    assert s.words == {} and s.cut("天地") == ["天", "地"]


def test_shared_chances_give_the_same_counts():
    words = {"a": -1.0, "b": -2.0, "ab": -0.5, "ba": -3.0}
    chances = {w: math.exp(p) for w, p in words.items()}
    assert all(segment.expected(run, words, 2) == segment.expected(run, words, 2, chances) for run in ("", "a", "abab", "bcab"))
