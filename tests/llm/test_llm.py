"""The operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

import collections
import functools
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.llm import common, components, exact_dedup, fertility, html_extract, html_train, license_scan, line_dedup, mixing, near_dedup, packing, substring_dedup, token_files

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACES = r"[\x20\x09-\x0D]+"
TOKENIZER = common.tokenizer_path("byte_bpe_50k.json")
PIECES = common.tokenizer_path("piece_bpe_32k.model")


def corpus():
    """Copies, near copies, shared passages, repeats, null and empty texts, ties, a null source and id."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeéñ", k=r.randint(2, 7))) for _ in range(400)]
    long = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = long(60)
    texts = [long(r.randint(60, 200)) for _ in range(30)]
    for i in range(8):
        texts.append(f"{long(40)} {passage}\n{long(30)}")
        texts.append(texts[i])
        texts.append(texts[i].replace(" ", "  \n", 3))
        words = texts[i].split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    same = long(50)
    texts += [f"{same} {same}", "a b c", "a b c", " a  b c ", "one", "", None, "   \n\t ", "line one is here\nline two is here\nline one is here", "&&& *** $$$", "x" * 5000, long(3000)]
    rows = [(i, t, r.choice(["en", "fr", None, "zz"]), r.choice(["s1", "s1", "s1", "s2", "s3", None]), 0) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus as a staged table with columns whose names the operators use."""
    df = spark.createDataFrame(corpus(), DOCS)
    extra = df.withColumns({"rid": F.lit("mine"), "keep_id": F.lit(1), "kept": F.lit("x"), "size": F.lit(2), "batch": F.lit(3), "id": F.lit(4), "key": F.lit(5)})
    return common.stage(extra.repartition(4), "docs")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- tokens -------------------------------------------------------------------

ODD = ["", " ", "it's don't 'tis I'LL\t\tx", "<|endoftext|> a", "日本語 テキスト です。", "смешно 123½ ²", "\x1c\x85 x", "😀 hi 👩‍👩‍👧", "trail   ", "\r\n\r\n x", "ǅ ʼn ª", "a­ b c", "!'s ''re"]


def test_tokens_are_the_librarys():
    t = common.Tokens(TOKENIZER, memory=50)
    texts = [x for _, x, *_ in corpus() if x] + ODD
    want = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for size in (1, 7, 100):
        assert [x.tolist() for a in range(0, len(texts), size) for x in t.encode(texts[a : a + size])] == want


BITS = ["'", "'s", "'re", "'ll", "'ve", "'d", "'S", " ", "  ", "\n", "\t", "\r\n", "\x0b", "a", "s", "l", "7", "½", "é", "日本", "ж", "!", "…", "‘", "€", "xylophone" * 3]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=12))
def test_tokens_of_pieces_that_meet(texts):
    """Apostrophes, white space and classes of characters in all orders, several texts at once, a memory that forgets."""
    t = small_memory()
    assert [x.tolist() for x in t.encode(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@functools.cache
def small_memory():
    return common.Tokens(TOKENIZER, memory=200)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_tokens_of_any_text(text):
    t = token_files.shared_tokens(TOKENIZER)
    assert t.encode([text])[0].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]), st.integers(1, 20))
def test_planes_round_trip(ids, shuffle, block):
    a = np.array(ids, np.uint32)
    payload, chunks = token_files.pack(a, block, shuffle)
    assert token_files.unpack(payload, chunks, shuffle).tolist() == ids
    assert all(payload[c["offset"] : c["offset"] + 4] == b"\x28\xb5\x2f\xfd" for c in chunks)


@pytest.mark.parametrize("shuffle", ["bit", "byte"])
def test_token_files(spark, docs, rows, shuffle):
    path = common.scratch(spark, "ids")
    token_files.write(docs, path, TOKENIZER, end_id=2, block_ids=100, segment_ids=500, shuffle=shuffle)
    t = token_files.shared_tokens(TOKENIZER)
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or "")))
    want, at = [], 0
    for d, text, *_ in order:
        ids = [*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.digest(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    back = token_files.read(spark, path).orderBy("part", "segment", "place").collect()
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back] == [w[3] for w in want]
    assert token_files.index(spark, path).agg(F.sum(F.when(F.col("plane") == 0, F.col("n_ids")))).first()[0] == at


def test_token_files_empty(spark, empty):
    path = common.scratch(spark, "ids")
    token_files.write(empty, path, TOKENIZER)
    assert token_files.digest(spark, path).count() == 0


# -- exact dedup --------------------------------------------------------------


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(docs, rows, fan_in):
    norm = lambda t: re.sub(SPACES, " ", t or "")
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    got = exact_dedup.dedup(docs, fan_in=fan_in).collect()
    first = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    want = sorted((str(d), str(first[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1}
    assert len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns(docs):
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup.dedup(docs).where("kept").count()


# -- mixing -------------------------------------------------------------------


def water(sizes, share=1.5, most=2.0):
    """Targets by reasoning step by step: whoever is above the cap stops there, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: [5.0, 2.0, 1.0][i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("bucket", [1, 4096])
def test_mixing(docs, rows, bucket):
    got = mixing.mix(docs, bucket_rows=bucket).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want, taken = water(sizes), collections.Counter()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(words(t))) for d, t, *_ in rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in want} == {s: int(v + 1e-6) for s, v in want.items()}
    again = {(r.rid, r.taken) for r in mixing.mix(docs, bucket_rows=bucket).collect()}
    assert again == {(r.rid, r.taken) for r in got}


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    total = mixed.agg(F.sum(common.n_words(F.col("text")))).first()[0]
    assert total == mixing.mix(docs).agg(F.sum("taken")).first()[0]


# -- extraction ---------------------------------------------------------------


def test_extraction_on_held_out_pages():
    model = json.loads(html_extract.MODEL.read_text())
    for family in html_train.FAMILIES:
        assert html_train.accuracy(model, html_train.pages(99, 40, [family])) > 0.975, family


def test_parsing_takes_linear_time():
    """A megabyte of what a parser can stumble over: open quotes and tags, comments, deep nesting, stray ends."""
    model = json.loads(html_extract.MODEL.read_text())
    for piece in ('<a "', '<a ="', '<a class="x', "<b>", "<p><i>", "<ul><li><b>", "<!--", "</b>", "<", "<script>", "<td><table>"):
        began = time.time()
        html_extract.extract([piece * (2**20 // len(piece))], model)
        assert time.time() - began < 20, piece


def test_odd_tags():
    model = json.loads(html_extract.MODEL.read_text())
    text = "This is a sentence of some length that reads well, and there is another one after it. "
    page = f"<body><article><p title='a > b' data-x=\"c > d\" checked>{text}</p><P>{text}<!-- <p>no</p> -->1 < 2<br/>x<p>{text}</article><!DOCTYPE x><footer>foot</footer><p class=\"x"
    t = text.strip()
    assert html_extract.extract([page], model) == [f"{t}\n{t} 1 < 2 x\n{t}"]


def test_decoding_is_consistent_and_best():
    r = np.random.RandomState(0)
    for _ in range(30):
        p = html_extract.Page("<div><p>a<b>b</b></p><ul><li>c</li></ul></div><p>d</p>", [0.0] * html_extract.BUCKETS)
        p.features()
        odds = r.normal(size=len(p.tag)) * 2
        kept = p.decode(odds)
        n = len(p.tag)
        best, arg = -np.inf, None
        for mask in range(1 << (n - 1)):
            y = [True, *(bool(mask >> i & 1) for i in range(n - 1))]
            if all(y[p.parent[i]] or not y[i] for i in range(1, n)):
                v = sum(-np.logaddexp(0, -o if k else o) for o, k in zip(odds, y, strict=True))
                if v > best:
                    best, arg = v, y
        assert kept.tolist() == arg


def test_main_text(spark):
    page = "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text, of some length that reads well.<p>Second one &eacute; with more words in it, too.</p></article><div class='comments'><p>nice post, thanks a lot</p></div><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, "v", None, 2), (3, None, "", 3), (None, "w", page, 4), (5, "z", "<" * 3000, 5)], "page_id bigint, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.main_text(df).collect()}
    text = "A & B\nFirst bold text, of some length that reads well.\nSecond one é with more words in it, too."
    assert got[1, "u"] == got[None, "w"] == (text, len(text))
    assert got[2, "v"] == got[3, None] == ("", 0)
    assert html_extract.main_text(df.where("false")).count() == 0


# -- license scan -------------------------------------------------------------


def test_license_scan(spark):
    texts = [
        "Released under the MIT License. MIT-license!",
        "Licenced under the Apache Licence, Version 2.0",
        "permission is hereby granted, free of charge, to any persn obtaining a copy of this software",
        "an apacheé license, a summit license",
        "GNU Lesser General Public License apache license",
        "",
        None,
        "x mit license mit license",
        "Licensed under CC BY-NC 4.0.",
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].n_base for i in range(9)] == [2, 0, 0, 0, 2, 0, 0, 2, 0]
    assert [(got[i].first_word, got[i].last_word) for i in (0, 4, 7, 6)] == [(3, 5), (2, 5), (1, 3), (None, None)]
    assert [got[i].base_labels for i in range(9)] == ["mit", "", "", "", "apache,gpl", "", "", "mit", ""]
    assert [got[i].labels for i in range(9)] == ["mit", "apache", "mit", "", "apache,gpl", "", "", "mit", "cc-by-nc"]
    assert got[0].score == 1.0
    assert 0.9 < got[1].score < 1.0
    s = got[1].spans[0]
    assert texts[1][s.start : s.stop] == texts[1]
    assert (s.first_word, s.last_word, s.errors) == (0, 7, 2)
    assert got[6].n_words == 0


def edits(a, b):
    """Fewest edits that turn a into a stretch of b, by where the stretch ends."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [row[0] + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row


def test_every_notice_is_found_by_brute_force():
    """Texts with several notices, exact and not: each planted one is in a span of its label, and each span is within the bound."""
    r, notices = random.Random(9), ["released under the mit license", "licensed under the apache license version 2 0"]
    s = license_scan.Searcher({"mit": [notices[0]], "apache": [notices[1]]}, 0.08)
    for _ in range(150):
        text, planted = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join("".join(r.choices("abcdelr", k=r.randint(1, 7))) for _ in range(r.randint(0, 9))) + " "
            which = r.randrange(2)
            t = list(notices[which])
            for _ in range(r.choice([0, 0, 1, 2])):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], ["q"], [t[i], "q"]])
            planted.append((("mit", "apache")[which], len(text), len(text) + len(t)))
            text += "".join(t) + " "
        got = s.search(text)
        for label, a, b in planted:
            assert any(x[0] == label and x[1] < b and a < x[2] for x in got), (text, label, a, b)
        for label, a, b, n, _ in got:
            notice = notices[label == "apache"]
            assert n <= license_scan.errors_allowed(notice) and edits(notice, text[a:b])[-1] <= n


def test_a_worse_copy_before_a_better_one_is_found(spark):
    df = spark.createDataFrame([(1, "undr the mit license and released undr the mit license; " + "x " * 20 + "released under the mit license")], "doc_id bigint, text string")
    spans = license_scan.scan(df).first().spans
    assert [(x.label, x.errors) for x in spans] == [("mit", 1), ("mit", 0)]
    assert license_scan.scan(df.where("false")).count() == 0


def test_pieces_find_every_match_within_the_bound():
    s = license_scan.Searcher({"x": ["released under the mit license"]}, 0.08)
    r = random.Random(1)
    for _ in range(300):
        t = list("released under the mit license")
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], [r.choice("abc")], [t[i], "q"]])
        assert s.search("some words " + "".join(t) + " and more")


def test_license_words(docs, rows):
    """Words, base places and labels against brute force, for every row: nulls, empty and long texts, repeated rows."""

    def lower(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    want = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# -- substring dedup ----------------------------------------------------------


def brute_windows(rows, size):
    count = collections.Counter()
    for _, t, *_ in rows:
        w = words(t)
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("size", "batch"), [(35, 8), (35, 1), (8, 2), (3, 8), (2, 3), (1, 3)])
def test_substring_dedup(docs, rows, size, batch):
    got = substring_dedup.remove_repeats(docs, window=size, batch_rows_log2=batch, bucket_bytes=4000).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_windows(rows, size)


def test_substring_levels_go_on_until_nothing_survives(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = common.stage(spark.createDataFrame([(1, text), (2, text + " more"), (3, "z " * 50)], "doc_id bigint, text string"), "levels")
    got = {r.doc_id: (r.longest, r.n_removed, [tuple(s) for s in r.spans]) for r in substring_dedup.remove_repeats(df, window=35, max_length=10**6).collect()}
    assert got == {1: (140, 200, [(0, 200)]), 2: (140, 200, [(0, 200)]), 3: (35, 50, [(0, 50)])}


def test_windows_of_words_that_sums_confuse(spark):
    morse = lambda a, b: "".join(a if i.bit_count() % 2 else b for i in range(1024))
    texts = [" ".join([f"w{i}" for i in range(17)] + [x] + [f"w{i}" for i in range(17, 34)]) for x in (morse("a", "b"), morse("b", "a"))]
    df = common.stage(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "morse")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]


def test_substring_dedup_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# -- near dedup ---------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def grams(t, k=5):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def partition(pairs):
    out = collections.defaultdict(set)
    for key, x in pairs:
        out[key].add(x)
    return sorted(sorted(v) for v in out.values())


def union(n, linked):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in linked:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_near_dedup(docs, rows):
    got = sorted(near_dedup.classes(docs).collect(), key=lambda r: r.rid)
    marked, key = common.with_key(docs)
    data = sorted(marked.select(key, "text").collect(), key=lambda r: r[0])
    sets = [grams(r.text) for r in data]
    linked = [(i, j) for i in range(len(data)) for j in range(i) if (not sets[i] and not sets[j]) or jaccard(sets[i], sets[j]) >= 0.8]
    want = union(len(data), linked)
    assert [r.rid for r in got] == [r[0] for r in data]
    by_class = collections.defaultdict(list)
    for r, c in zip(got, want, strict=True):
        by_class[c].append(r)
    for members in by_class.values():
        first = min((m.doc_id for m in members if m.doc_id is not None), default=None)
        assert {m.class_id for m in members} == {first}
        assert {m.class_size for m in members} == {len(members)}
        assert sum(m.kept for m in members) == 1


def test_near_dedup_empty(empty):
    assert near_dedup.classes(empty).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.RandomState(3)
    e = r.randint(1, 2**62, 60).astype(np.uint64)
    w = [r.uniform(0.5, 4, 40), r.uniform(0.5, 4, 40)]
    at = [np.arange(40), np.arange(20, 60)]
    p = np.zeros((2, 60))
    for i in (0, 1):
        p[i, at[i]] = w[i]
    both = np.flatnonzero((p > 0).all(0))
    exact = sum(1 / np.maximum(p[0] / p[0, i], p[1] / p[1, i]).sum() for i in both)
    sig = near_dedup.prob_minhash(np.repeat([0, 1], 40), np.concatenate([e[at[0]], e[at[1]]]), np.concatenate(w), 2, 8192)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.02)


def test_probability_jaccard():
    r = np.random.RandomState(4)
    x, y = r.uniform(0, 3, 50) * (r.rand(50) < 0.8), r.uniform(0, 3, 50) * (r.rand(50) < 0.8)
    kept = (x > 0) | (y > 0)
    x, y = x[kept], y[kept]
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))
    assert near_dedup.probability_jaccard(x, y) == pytest.approx(exact)
    both = np.array([1.0, 1, 1, 1, 0]), np.array([1.0, 1, 1, 0, 1])
    assert near_dedup.probability_jaccard(*both) == pytest.approx(3 / 5)


def weighted_jaccard(a, b, k=5):
    """Probability Jaccard similarity of 1 + ln of the counts of shingles."""
    grams_of = lambda w: collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    x, y = ({g: 1 + np.log(c) for g, c in grams_of(words(t)).items()} for t in (a, b))
    every = [(x.get(g, 0.0), y.get(g, 0.0)) for g in {*x, *y}]
    p, q = np.array(every).T
    return sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in np.flatnonzero((p > 0) & (q > 0)))


def variants(seed, n=120, length=70):
    """Texts that differ from one text, and some from each other only, in a few words; parts of some stand several times."""
    r = random.Random(seed)
    base, out = [f"w{r.randrange(3000)}" for _ in range(length)], []
    for i in range(n):
        w = list(r.choice(out).split()) if out and r.random() < 0.6 else list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        if r.random() < 0.3:
            w = w[:20] * r.randint(1, 4) + w
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_near_dedup_of_a_large_group(spark, block):
    """Leaders, blocks and tiles against all pairs; only pairs at the very threshold can lack a common band."""
    texts = variants(1, 60) + variants(2, 15, 200)
    df = common.stage(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), "variants")
    sets = [grams(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8 or weighted_jaccard(texts[i], texts[j]) >= 0.8]
    want = union(len(texts), linked)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df, block=block).collect()}
    assert partition(zip(want, range(len(texts)), strict=True)) == partition((got[i], i) for i in range(len(texts)))


def test_near_dedup_of_repeated_phrases(spark):
    """Texts alike by their sets whose weights differ, and the other way round: both kinds link, others don't."""
    r = random.Random(6)
    texts, plain, weighted = [], [], []
    for i in range(20):
        same, left, right = ([f"{c}{i}x{r.randrange(10**9)}" for _ in range(n)] for c, n in (("s", 100), ("l", 5), ("r", 5)))
        texts += [" ".join(same + left * 1000), " ".join(same + right * 1000)]  # plain 0.84, weighted about 0.5
        plain.append((2 * len(plain), 2 * len(plain) + 1))
    at = len(texts)
    for i in range(20):
        same, left, right = ([f"{c}{i}y{r.randrange(10**9)}" for _ in range(n)] for c, n in (("s", 60), ("l", 13), ("r", 13)))
        texts += [" ".join(same * 40 + left), " ".join(same * 40 + right)]
        weighted.append((at + 2 * i, at + 2 * i + 1))
    for pairs, low, high in ((plain, 0, 1), (weighted, 1, 0)):
        for a, b in pairs:
            j = jaccard(grams(texts[a]), grams(texts[b])), weighted_jaccard(texts[a], texts[b])
            assert j[low] >= 0.8 > j[high]
    df = common.stage(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "repeats")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_leaders_and_open_buckets(spark):
    """Leaders link only what verify says; buckets of one component are closed."""
    rows = [(1, i, 10, 0) for i in range(20)] + [(2, i, 10, 0) for i in range(100, 105)]
    members = common.stage(spark.createDataFrame(rows, "key bigint, id bigint, n bigint, weight int"), "members")
    got = components.leaders(members, lambda p: p.where("a < 100"), 0.8)
    assert {r.id: r.comp for r in got.collect()} == {i: 0 for i in range(20)}
    assert {r.key for r in components.open_members(members, got).collect()} == {2}
    assert components.leaders(members, lambda p: p.where("false"), 0.8).count() == 0


def test_names_of_columns(spark):
    """Names as Spark matches them; a missing column is an error, and clashing names of other columns do no harm."""
    df = spark.createDataFrame([(1, "a b", "mine"), (2, "a  b", "mine")], "Doc_ID bigint, TEXT string, RID string")
    assert {r.group_size for r in exact_dedup.dedup(df).collect()} == {2}
    kept = exact_dedup.kept_documents(common.stage(df, "names"))
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b", "mine")]
    with pytest.raises(ValueError, match="txt"):
        exact_dedup.dedup(df, text_col="txt")


def test_words_of_all_lengths_have_their_own_hashes():
    """Words that differ in one byte, in length, or by letters in Thue-Morse order, which sums modulo 2 ** 64 confuse."""
    morse = lambda n, a, b: "".join(a if i.bit_count() % 2 else b for i in range(n))
    words_ = ["a" * n for n in range(1, 40)] + ["a" * n + "b" for n in range(40)] + ["\0" * n for n in range(1, 20)] + [morse(1024, "a", "b"), morse(1024, "b", "a")]
    words_ = list(dict.fromkeys(words_))
    texts = pa.array([" ".join(words_)])
    data, offsets = common.row_bytes(texts)
    starts, ends, _ = common.word_starts(data, offsets)
    for h in common.word_halves(data, starts, ends):
        assert len(set(h.tolist())) == len(words_) == len(h)


# -- line dedup ---------------------------------------------------------------


def clean(line):
    return re.sub(SPACES, " ", line).lower().strip(" ")


def test_line_dedup(spark):
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(300)]
    lines = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 25))) for _ in range(120)]
    for i in range(60):
        w = lines[i].split()
        w[r.randrange(len(w))] += r.choice(["", "x"])
        lines.append(("  " if i % 3 else "") + " ".join(w).upper())
    lines += ["", " ", "***", "***", "日本語のとても長い文章です", "日本語のとても長い文章です！"]
    r.shuffle(lines)
    texts = ["\n".join(lines[i : i + 6]) for i in range(0, len(lines), 6)] + ["", None, lines[0]]
    df = common.stage(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, line string"), "lines")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    flat = [(d, n, clean(x)) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if clean(x)]
    sets = [full_set(x) for *_, x in flat]
    linked = [(i, j) for i in range(len(flat)) for j in range(i) if flat[i][2] == flat[j][2] or jaccard(sets[i], sets[j]) >= 0.8]
    first = {}
    for (d, n, _), c in zip(flat, union(len(flat), linked), strict=True):
        first.setdefault(c, (d, n))
    stay = set(first.values())
    for d, t in enumerate(texts):
        ls = (t or "").split("\n")
        want = "\n".join(x for n, x in enumerate(ls) if not clean(x) or (d, n) in stay)
        assert got[d].n_lines == sum(bool(clean(x)) for x in ls)
        assert got[d].kept_text == want
    assert len(linked) > 40
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def full_set(line, width=8):
    return frozenset([line[i : i + width] for i in range(len(line) - width + 1)] or [line])


def test_lines_have_shingles_at_every_character(spark):
    """Lines that differ inside a word are different lines."""
    lines = ["Invoice number 202400000001", "Invoice number 202499999999", "Responsibilities", "Responsible", "Internationalisation", "Internationally", "😀" * 3 + "abcdefgh" * 60, "short", "12345678"]
    df = common.stage(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string"), "inside")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == dict.fromkeys(range(len(lines)), 0)
    got = line_dedup.exploded(common.keyed(df, doc_id="doc_id", text="text")).select("doc_id", F.size(line_dedup.shingle_set(F.col("line"), 8)).alias("n"))
    assert {r.doc_id: r.n for r in got.collect()} == {i: len(full_set(clean(t))) for i, t in enumerate(lines)}


def test_lines_by_brute_force(spark):
    """Lines of all lengths with changed words and characters, against all pairs of full sets."""
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(300)]
    lines = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(120)]
    for i in range(120):
        at = r.randrange(len(lines[i]))
        lines.append(r.choice([lines[i] + "x", lines[i][:at] + "é" + lines[i][at + 1 :], lines[i].upper()]))
    r.shuffle(lines)
    df = common.stage(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"), "brute")
    sets = [full_set(clean(x)) for x in lines]
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    first = {}
    for i, c in enumerate(union(len(lines), linked)):
        first.setdefault(c, i)
    got = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_dropped = 0").collect()}
    assert got == set(first.values())
    assert len(linked) > 40


def unfound(pairs):
    """How many pairs of sets (x, y) share no key."""
    pairs = pairs.withColumn("k", F.monotonically_increasing_id())
    x, y = (line_dedup.with_keys(pairs.select("k", F.col(c).alias("hashes")), 0.8, 9, 3).select("k", F.col("keys").alias(f"{c}k")) for c in "xy")
    return x.join(y, "k").where(~F.arrays_overlap("xk", "yk")).count()


def test_bands_find_large_sets(spark):
    """Pairs of larger sets at exactly 0.8, by size: at most 0.5 % share no band."""
    r = random.Random(8)
    for union_size in (35, 45, 65, 130, 260):
        common_size, rows = union_size * 4 // 5, []
        for _ in range(2000):
            h = [r.randrange(-(2**63), 2**63) for _ in range(union_size)]
            half = (union_size - common_size) // 2
            rows.append((sorted(h[: common_size + half]), sorted(h[:common_size] + h[common_size + half :])))
        assert unfound(spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")) <= 10, union_size


def test_line_dedup_leaves_no_keys_and_shuffles(spark, monkeypatch):
    """Of what was staged the keys and signatures are gone, and the shuffle files of each step with the step."""
    names, paths = [], {}

    def staged(df, name, *by):
        out = common.stage(df, name, *by)
        names.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        paths.setdefault(name, out.staged_at)
        return out

    monkeypatch.setattr(line_dedup, "stage", staged)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = common.stage(spark.createDataFrame([(i, f"the first line of this text\nanother line of the text number {i % 3}") for i in range(9)], "doc_id bigint, text string"), "freed")
    got = line_dedup.dedup_lines(df)
    there = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert {k for k, p in paths.items() if not there(p)} == {"line_signatures", "line_keys"}
    assert set(names) == {"true"} and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert sum(r.n_dropped for r in got.collect()) == 16


def test_lines_of_a_large_bucket(spark):
    """Leaders and blocks against all pairs: variants of a few lines, some like a chain, and copies."""
    r = random.Random(21)
    base = [" ".join("".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(40)) for _ in range(3)]
    lines = list(base)
    for _ in range(110):
        w = r.choice(lines).split()
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = "".join(r.choices("klmnop", k=6))
        lines.append(" ".join(w))
    df = common.stage(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"), "bucket")
    sets, first = [full_set(clean(x)) for x in lines], {}
    hashed = line_dedup.exploded(common.keyed(df, doc_id="doc_id", text="text")).select("doc_id", line_dedup.shingle_set(F.col("line"), 8).alias("hashes"))
    keys = {r.doc_id: {*r["keys"]} for r in line_dedup.with_keys(hashed, 0.8, 9, 3).collect()}
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8 and keys[i] & keys[j]]
    for i, c in enumerate(union(len(lines), linked)):
        first.setdefault(c, i)
    for block in (8, 256):
        got = {r.doc_id for r in line_dedup.dedup_lines(df, block=block).where("n_dropped = 0").collect()}
        assert got == set(first.values())


def test_small_sets_share_a_key(spark):
    """Every pair of small sets at the threshold or above shares a key, whatever the hashes are."""
    r = random.Random(3)
    shapes = [(a, b, c) for a in range(1, 31) for b in range(a, 38) for c in range(1, a + 1) if min(a, b) <= 24 and 0.8 <= c / (a + b - c) < 0.84]
    rows = []
    for k in range(1500):
        a, b, c = shapes[k % len(shapes)]
        h = [r.randrange(-(2**63), 2**63) for _ in range(a + b - c)]
        rows.append((sorted(h[:a]), sorted(h[a - c :])))
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>")
    assert unfound(df) == 0
    assert df.where(F.size(F.array_intersect("x", "y")) == 0).count() == 0


# -- quality rules ------------------------------------------------------------


def test_fertility(docs, rows):
    got = fertility.measure(docs, TOKENIZER, PIECES).collect()
    want = []
    for d, t, *_ in rows:
        w, t = words(t), t or ""
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = set()
        for i in range(len(w) - 2):
            if tri[tuple(w[i : i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((str(d), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), failed))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert any(r.kept for r in got)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000é"), max_size=30))
def test_words_of_any_text(text):
    assert common.words_of(text) == words(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.sampled_from([0, 1 << 20, 1 << 30]))
def test_repeated_words(ids, base):
    windows = collections.Counter(tuple(ids[i : i + 3]) for i in range(len(ids) - 2))
    inside = {i + k for i in range(len(ids) - 2) if windows[tuple(ids[i : i + 3])] > 1 for k in range(3)}
    assert fertility.repeated_words(np.array(ids, np.int64) + base) == len(inside)


def test_fertility_bands(spark):
    r = random.Random(2)
    prose = " ".join(r.choice("the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your river stone market garden winter morning teacher letter music bridge window paper silver travel answer quiet follow build carry young early strong simple heavy".split()) + r.choice(["", "ing", "ed"]) for _ in range(150))
    noise = " ".join("".join(chr(r.randrange(0x13000, 0x13400)) for _ in range(5)) for _ in range(120))
    digits = " ".join(str(r.randrange(10**9)) + "§±" for _ in range(120))
    df = spark.createDataFrame([(1, prose, "en"), (2, noise, "en"), (3, digits, None), (4, None, None)], "doc_id bigint, text string, lang string")
    got = {x.doc_id: (x.kept, x.band) for x in fertility.measure(df, TOKENIZER, PIECES).collect()}
    assert got[1] == (True, "en")
    assert got[2] == (False, "en")
    assert got[4] == (False, "")
    russian = " ".join(r.choice("вода земля небо окно улица письмо вечер утро город слово время".split()) + r.choice(["", "м", "ми"]) for _ in range(150))
    named = spark.createDataFrame([(i, russian, x) for i, x in enumerate([None, "", "latin", "other"])], "doc_id bigint, text string, lang string")
    assert {(x.kept, x.band) for x in fertility.measure(named, TOKENIZER, PIECES).collect()} == {(True, "cyrillic")}
    both = df.withColumn("c0", F.lit("mine"))
    kept = fertility.kept_documents(both, TOKENIZER, PIECES)
    assert kept.columns == both.columns
    assert sorted((x.doc_id, x.c0) for x in kept.collect()) == sorted((d, "mine") for d, (ok, _) in got.items() if ok)
    assert fertility.measure(df.where("false"), TOKENIZER, PIECES).count() == 0


# -- packing ------------------------------------------------------------------


@pytest.mark.parametrize(("length", "shard"), [(2048, 1 << 20), (64, 5000)])
def test_packing(docs, rows, length, shard):
    got = packing.pack(docs, TOKENIZER, end_id=1, length=length, shard_bytes=shard).collect()
    t = token_files.shared_tokens(TOKENIZER).tokenizer
    want = collections.Counter((str(d), tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for d, x, *_ in rows)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        assert p.length * 4 == len(p.ids) > 0
        by_seq[p.sequence_id].append(p)
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        short += at < length
    size = sum(len((r[1] or "").encode()) for r in rows)
    ranges = -(-size // (4 * shard))
    assert short <= ranges + size // shard
    for p in got:
        by_doc[str(p.doc_id)].append(p)
    for d, n in collections.Counter(str(r[0]) for r in rows).items():
        pieces = by_doc[d]
        assert sum(p.length for p in pieces) == sum(len(ids) * c for (x, ids), c in want.items() if x == d)
        if n == 1:
            pieces.sort(key=lambda p: p.start)
            joined = np.frombuffer(b"".join(p.ids for p in pieces), "<u4")
            assert (d, tuple(joined.tolist())) in want
            assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()


def test_packing_finds_related_documents():
    r = random.Random(7)
    topics = [["".join(r.choices("abcdefgh", k=6)) for _ in range(30)] for _ in range(5)]
    texts = [" ".join(r.choice(topics[i % 5]) for _ in range(40)) for i in range(50)]
    index = packing.Index(pa.array(texts, pa.large_string()))
    for first in (3, 48, 100):
        near = np.concatenate(list(index.neighbours(0, np.eye(1, 50, 0, bool)[0], first))).tolist()
        assert {x % 5 for x in near[:9]} == {0}
        scores = brute_bm25(texts, 0)
        assert near == sorted((i for i in range(1, 50) if scores[i]), key=lambda i: (-scores[i], i))
    used = np.arange(50) < 25
    before = np.concatenate(list(index.neighbours(0, used)))
    index.compact(used)
    assert before.tolist() == np.concatenate(list(index.neighbours(0, used))).tolist() == [i for i in near if i >= 25]


def test_lexical_shards_hold_related_documents(spark):
    """Of documents of 40 topics in random order, dealt into 20 shards, neighbours in a sequence share a topic far more often."""
    r = random.Random(17)
    topics = [["".join(r.choices("abcdefghijklm", k=r.randint(4, 12))) for _ in range(40)] for _ in range(40)]
    which = [r.randrange(40) for _ in range(1200)]
    rows = [(i, " ".join(r.choice(topics[t]) for _ in range(60))) for i, t in enumerate(which)] + [(2000, ""), (2001, None)]
    df = common.stage(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "topics")
    share = {}
    for lexical in (True, False):
        by_seq = collections.defaultdict(list)
        for p in packing.pack(df, TOKENIZER, length=512, shard_bytes=8000 * 4, lexical=lexical).collect():
            if p.doc_id < 2000:
                by_seq[p.sequence_id].append((p.offset, which[p.doc_id]))
        pairs = [a[1] == b[1] for x in map(sorted, by_seq.values()) for a, b in zip(x, x[1:], strict=False)]
        share[lexical] = sum(pairs) / len(pairs)
    assert share[True] > 0.5 and share[True] > 1.25 * share[False], share


def brute_bm25(texts, seed, k1=1.5, b=0.75):
    docs = [collections.Counter(t.split()) for t in texts]
    df, avg = collections.Counter(w for d in docs for w in d), sum(len(t.split()) for t in texts) / len(texts)
    idf = {w: np.log((len(texts) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    part = lambda d, w: idf[w] * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * sum(d.values()) / avg))
    return [sum(part(d, w) for w in sorted(docs[seed]) if df[w] > 1 and w in d) for d in docs]


def test_packing_empty(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_index_of_more_documents_than_words():
    for texts in (["a", "", "", "", "a"], ["a b", *[""] * 40, "a c"], [""] * 9):
        index, last = packing.Index(pa.array(texts, pa.large_string())), len(texts) - 1
        found = [d for part in index.neighbours(0, np.arange(len(texts)) == 0) for d in part.tolist()]
        assert found == ([last] if texts[0] else [])


def test_packing_of_empty_texts(spark):
    rows = [(0, "a b"), *[(i, "" if i % 2 else None) for i in range(1, 10_001)], (10_001, "a c")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER, length=512, shard_bytes=100_000).collect()
    assert len({p.doc_id for p in got}) == 10_002 and sum(p.length for p in got) == sum(len(p.ids) // 4 for p in got) >= 10_004
    by = collections.defaultdict(list)
    for p in got:
        by[p.sequence_id].append((p.offset, p.length))
    assert all(sum(k for _, k in ps) <= 512 and all(a + k == b for (a, k), (b, _) in zip(sorted(ps), sorted(ps)[1:], strict=False)) for ps in by.values())
    assert len({q >> 32 for q in by}) > 1
