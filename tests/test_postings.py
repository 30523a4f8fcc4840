"""The index of postings in blocks: answers of the exhaustive sum, fewer postings, segments."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillet.operators import keyword
from quillet.operators.postings import Index


def corpus(spark, n=3000, seed=1):
    """Zipf-like words, a rare word in few documents; nulls, empty texts, long ones and ties among them."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=5)) for _ in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    rows = [(i, i, " ".join(r.choices(vocab, weights, k=r.randint(3, 60)) + ([f"rare{'abcdefghij'[i % 10]}"] if i % 97 == 0 else []))) for i in range(n)]
    rows += [(n, n, None), (n + 1, n + 1, ""), (n + 2, n + 2, "lo " * 5000 + "lolo " * 30_000), *((n + 3 + k, n + 3 + k, rows[0][2]) for k in range(4))]
    return spark.createDataFrame(rows, "id bigint, ord bigint, text string").repartition(4), vocab


def asked(spark, vocab):
    r = random.Random(2)
    rows = [(q, " ".join([*r.choices(vocab[:20], k=4), *r.choices(vocab[300:], k=2), f"rare{'abcdefghij'[q % 10]}"])) for q in range(12)]
    rows += [(20, vocab[0]), (21, f"{vocab[0]} {vocab[0]}"), (22, "unknownword"), (23, ""), (24, None), (25, "lolo")]
    return spark.createDataFrame(rows, "qid bigint, query string")


def answer(df):
    return sorted((x.qid, x.rank, x.id, x.score) for x in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    c, vocab = corpus(spark)
    index = Index(c.where("id % 2 = 0"), range_rows=8)  # so that 3,000 documents are many ranges
    index.append(c.where("id % 2 = 1 and id % 3 = 0"))
    index.append(c.where("id % 2 = 1 and id % 3 <> 0"))
    return index, c, asked(spark, vocab)


@pytest.mark.parametrize("k", [1, 5, 200])
def test_the_same_answers(built, k):
    index, c, q = built
    assert answer(keyword.search(index, q, k)) == answer(keyword.search(c, q, k))


def test_most_postings_are_left_out(built):
    index, _, q = built
    w = index.work(q.where("qid < 12"), 3).first()
    assert 0 < w.scored < w.postings / 3


def test_merged_segments(built):
    index, c, q = built
    before, n = answer(keyword.search(index, q, 5)), index.totals()
    index.merge()
    assert len(index.whole()) == 1 and index.totals() == n
    again = Index(path=index.path, spark=q.sparkSession)
    assert answer(keyword.search(again, q, 5)) == before


def test_half_a_segment_never_counts(spark, built):
    index, c, q = built
    before = answer(keyword.search(index, q, 5))
    index.blocks().write.parquet(f"{index.path}/segments/zzzz/blocks")
    assert answer(keyword.search(index, q, 5)) == before


def test_index_of_an_empty_corpus(spark, built):
    index = Index(built[1].where("false"))
    assert keyword.search(index, built[2], 5).collect() == []


def test_without_an_index_few_rows_leave_the_tasks(built):
    _, c, q = built
    every = keyword.scores(c, q).withColumn("score", F.round("score", 4))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    want = every.withColumn("rank", F.row_number().over(w) - 1).where("rank < 3")
    assert answer(keyword.search(c, q, 3)) == answer(want)
    assert keyword.best(c, q, 3, 1.5, 0.75).count() < every.count() / 10
    assert answer(keyword.search(c.where("false"), q, 3)) == []


def test_scores_are_rounded_as_sql_does(spark):
    x = np.array([0.00005, 1.00005, 2.67505, 0.30005, 1.23454999, 7.0, 12.34565, 0.1 + 0.2])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 4).alias("y")).collect()
    assert [round(r.y * 10_000) for r in got] == keyword.rounded(x[:, None])[:, 0].tolist()


def test_an_index_is_built_with_one_shuffle(built, capsys):
    index, c, _ = built
    index.made(c, 3007, "x").explain()
    plan = capsys.readouterr().out.split("ObjectHashAggregate", 1)[-1]
    assert plan.count("Exchange hashpartitioning(rng") == 1 and plan.count("Exchange") == 1 + plan.count("Exchange RoundRobin")


def test_searches_read_the_blocks_of_asked_tokens_alone(built):
    index, _, q = built
    p = index.search_plan(q.where("qid = 25"), 5, 1.5, 0.75)
    assert p["blocks"].select("token").distinct().count() == 1
