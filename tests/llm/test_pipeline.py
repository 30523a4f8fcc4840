"""The pipeline against its stages done by hand."""

import collections
import random
import re

import corpus_pipeline
from quillet.llm import common, mixing


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    vocab = ["".join(r.choices("aeioubcdlmnrst", k=r.randint(2, 8))) for _ in range(500)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(60, 150))) for _ in range(60)]
    near = base[7].split()
    near[10] = "altered"
    texts = base + [base[3], base[3].replace(" ", "\n"), " ".join(near), "too short", None, "", "same words again " * 40]
    rows = [(i, t, None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    want = [set(range(len(texts))) - {63, 64, 65, 66}]
    want.append(want[0] - {60, 61})
    want.append(want[1] - {62})
    for (_, step), expected in zip(corpus_pipeline.STAGES[:3], want, strict=False):
        docs = common.stage(step(spark, docs, str(tmp_path)), "t")
        assert docs.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
        assert {x.doc_id for x in docs.collect()} == expected
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = {x.doc_id: x.taken for x in mixing.mix(docs).collect()}
    mixed = common.stage(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "t")
    got = collections.Counter()
    for x in mixed.collect():
        assert texts[x.doc_id].startswith(x.text)
        got[x.doc_id] += count(x.text)
    assert dict(got) == {d: n for d, n in taken.items() if n}
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.start, p.length, bytes(p.ids)) for p in whole) == sorted((p.doc_id, p.start, p.length, bytes(p.ids)) for p in pieces)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
