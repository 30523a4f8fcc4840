"""Golden values of the gate, tokens, keyword scores, fusion, times to live and parsing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillet.functions import quality, text, ttl
from quillet.operators import dedup, keyword, maintenance


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


GATE = [
    ("got it", "length"),
    ("/usr/lib/app.conf", "noise"),
    ("deadbeefcafe", "noise"),
    ("commit abc123 something", "noise"),
    ("fixed bug in login page", "noise"),
    ("Visited a temporary office", "noise"),
    ("PR #123 merged today", None),
    ("Running tests now ok", None),
    ("Build passed on main", None),
    ("User is from Paris France", "code"),
    ("undef value here", "code"),
    ("from été onwards we go", "code"),
    ("Step 3 done with work", "task"),
    ("Phase done, moving on", None),
    ("修复 已完成：登录页面的问题处理", "task"),
    ("哈哈哈哈哈哈哈哈哈哈哈", "chat"),
    ("User earns $5000 per month with $30k savings", None),
    ("Push to GitHub only after review and approval", None),
    (" 　short　 ", "length"),
    ("", "length"),
    (None, "length"),
]


def test_gate(spark):
    assert values(spark, [t for t, _ in GATE], quality.reject_layer("t")) == [v for _, v in GATE]


def test_gate_strict(spark):
    assert values(spark, ["PR #123 merged today", "Running tests now ok"], quality.reject_layer("t", strict=True)) == ["noise", "noise"]


CORPUS = ["The cat is a Sphynx and Devon Rex mix", "Monthly salary 5000, savings 300k.", "The cat sat. The cat ran.", "月薪 3.5万 存款 20万"]


def test_tokens(spark):
    got = values(spark, CORPUS, text.tokens("t"))
    assert got == [["cat", "sphynx", "devon", "rex", "mix"], ["monthly", "salary", "5000,", "savings", "300", "."], ["cat", "sat", ".", "cat", "ran", "."], ["月薪", "3.5万", "存款", "20万"]]


@pytest.mark.parametrize(
    ("query", "want"),
    [("cat mix", {0: 1.9387, 2: 0.9467}), ("cat cat", {2: 1.8935, 0: 1.4167}), ("salary 5000,", {1: 2.2625}), ("存款", {3: 1.3484}), ("the is", {})],
)
def test_bm25(spark, query, want):
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(CORPUS)], "id bigint, ord bigint, text string")
    got = keyword.search(corpus, spark.createDataFrame([(0, query)], "qid int, query string")).orderBy("rank").collect()
    assert {r.id: r.score for r in got} == want
    assert [r.id for r in got] == list(want)


def test_bm25_empty_corpus(spark):
    corpus = spark.createDataFrame([], "id bigint, ord bigint, text string")
    assert keyword.search(corpus, spark.createDataFrame([(0, "cat")], "qid int, query string")).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(1, 0), (3, 0)], "id int, rank int")
    got = {r.id: round(r.score, 4) for r in keyword.fuse([(a, 0.6), (b, 0.4)]).collect()}
    assert got == {1: 0.0164, 2: 0.0097, 3: 0.0066}


def test_ttl(spark):
    rows = [["temporary", "static"], ["static", "dynamic"], ["preference"], [], ["unknown"], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, tags array<string>").orderBy("i")
    assert [r[0] for r in df.select(ttl.ttl_of("tags")).collect()] == [30, 180, 365, 180, 180, 180]


DAY = dt.datetime(2026, 1, 1)
DUE = [
    (DAY, dt.datetime(2026, 1, 31), "2026-01-31 00:00:01", True),
    (DAY, dt.datetime(2026, 1, 31), "2026-01-31 00:00:00", False),
    (DAY, None, "2026-01-31 23:59:59", False),
    (DAY, None, "2026-02-01 00:00:00", True),
    (None, dt.datetime(2020, 1, 1), "2026-02-01 00:00:00", False),
]


@pytest.mark.parametrize(("created", "expire", "now", "want"), DUE)
def test_due(spark, created, expire, now, want):
    df = spark.createDataFrame([(created, expire, 30, ["temporary"])], "created_at timestamp, expire_at timestamp, ttl_days int, tags array<string>")
    utc = df.select(*[F.expr(f"to_timestamp(date_format({c}, 'yyyy-MM-dd HH:mm:ss'))").alias(c) for c in ("created_at", "expire_at")], "ttl_days", "tags")
    assert utc.select(ttl.due(F.expr(f"timestamp'{now}'"))).first()[0] is want


def test_parsing(spark):
    assert values(spark, ['["a","b"]', "a, b,,", "123", "", None], text.parse_tags("t")) == [["a", "b"], ["a", "b"], ["123"], [], []]
    got = values(spark, ["a:b:person|c", "", None], text.parse_entities("t"))
    assert [[(e.text, e.label) for e in x] for x in got] == [[("a:b", "person"), ("c", "unknown")], [], []]


def test_numeric_facts(spark):
    rows = [(1, "月薪 3.5万 存款20万"), (2, "月收入 8000元"), (3, "月租3000元"), (4, None)]
    got = {(r.id, r.attr, r.value) for r in maintenance.numeric_facts(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {(1, "salary", 3.5), (1, "savings", 20.0), (2, "monthly_income", 8000.0), (2, "income", 8000.0), (3, "rent", 3000.0)}


TIERS = [(0.54, 1.0, "added"), (0.90, 0.24, "added"), (0.84, 0.25, "skipped"), (0.8399, 0.25, "flagged"), (0.72, 0.25, "flagged"), (0.7199, 0.9, "added")]


def test_tiers(spark):
    df = spark.createDataFrame([(s, o) for s, o, _ in TIERS], "s double, o double")
    assert [r[0] for r in df.select(dedup.tier(F.col("s"), F.col("o"))).collect()] == [t for *_, t in TIERS]


def test_keywords_and_overlap(spark):
    df = spark.createDataFrame([("the Cat and Dog, Cat", "dog bird"), ("", "")], "a string, b string")
    rows = df.select(text.keywords("a").alias("a"), text.keywords("b").alias("b")).select("a", F.round(text.overlap("a", "b"), 4).alias("o")).collect()
    assert [tuple(r) for r in rows] == [(["cat", "dog", ","], 0.25), ([], 0.0)]
