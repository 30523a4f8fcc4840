"""Toxicity, sessions and conversation repair against brute force and held-out accuracy, and their odd cases."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import queries, sessions, toxicity, turns

MINUTE = 60_000_000
CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string"


# -- sessions -----------------------------------------------------------------


def sessions_by_hand(rows, gap=5 * MINUTE, length=120 * MINUTE, late=60 * MINUTE):
    """rows: click_id, ts, arrived_at (microseconds), client_id, kind, value."""
    once = {}
    for r in sorted((r for r in rows if None not in (r[0], r[1], r[3])), key=lambda r: (r[1], r[3])):
        once.setdefault(r[0], r)
    clients = collections.defaultdict(lambda: ([], []))
    for c, ts, arrived, client, kind, value in once.values():
        sound = value is not None and math.isfinite(value)
        clients[client][arrived is not None and arrived - ts > late].append((ts, c, kind == "purchase" and sound and value >= 60, math.floor(100 * value + 0.5) if sound else 0))
    out = []
    for client, (timely, later) in clients.items():
        found, before = [], None
        for x in sorted(timely):
            why = "first" if before is None else "end" if before[2] else "gap" if x[0] - before[0] >= gap else "length" if x[0] - found[-1][0][0][0] > length else None
            if why and found:
                found[-1][1] = why
            if why:
                found.append([[x], None])
            else:
                found[-1][0].append(x)
            before = x
        for i, (c, why) in enumerate(found):
            after = found[i + 1][0][0][0] if i + 1 < len(found) else math.inf
            n_late = sum(c[0][0] <= x[0] < after for x in later)
            out.append((client, c[0][1], c[0][0], c[-1][0], len(c), n_late, sum(x[3] for x in c), why or ("end" if c[-1][2] else "none"), ",".join(str(x[1]) for x in c)))
    return sorted(out)


def clicks_frame(spark, rows):
    at = lambda us: None if us is None else np.datetime64(us, "us").item()
    return spark.createDataFrame([(c, at(t), at(a), k, kind, v, "{}") for c, t, a, k, kind, v in rows], CLICKS)


def sessions_of(spark, rows, parts, **how):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return sorted(map(tuple, sessions.sessions(clicks_frame(spark, rows), **how).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def odd_clicks(n, seed):
    """One client with most clicks, ties, late ones, ends, broken and repeated rows."""
    r, rows = random.Random(seed), []
    for i in range(n):
        client = r.choice([7, 7, 7, 1, 2, 3, None if r.random() < 0.1 else 4])
        ts = r.randrange(0, 40_000) * (MINUTE // 4 if client == 7 else MINUTE // 10) // 2
        ts = ts // MINUTE * MINUTE if r.random() < 0.3 else ts
        rows.append((i, None if r.random() < 0.02 else ts, r.choice([None, ts + 1, ts + 60 * MINUTE, ts + 60 * MINUTE + 1]), client, r.choice(["view", "purchase", None]), r.choice([None, 1.005, 60.0, 59.99, -3.0, float("nan"), float("inf")])))
    return rows + rows[:20] + [(None, 5, 5, 7, "view", 1.0)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_sessions(spark, parts):
    rows = odd_clicks(1500, parts)
    assert sessions_of(spark, rows, parts) == sessions_by_hand(rows)


def test_sessions_without_any_hard_cut(spark):
    """A click a minute for days: only lengths cut, so that every partition hands on what it was given."""
    rows = [(i, i * MINUTE + (i * 7919) % 1000, None, 7, "view", 1.0) for i in range(3000)]
    rows += [(5000 + i, i * MINUTE, None, 9, "view", None) for i in range(5)]
    assert sessions_of(spark, rows, 8) == sessions_by_hand(rows)


def test_sessions_of_late_clicks_in_between(spark):
    """Partitions that hold late clicks of a client alone pass on its session."""
    late = [(100 + i, 10 + i, 10 + i + 61 * MINUTE, 7, "view", 1.0) for i in range(400)]
    rows = [(1, 5, None, 7, "view", 1.0), *late, (2, 4 * MINUTE, None, 7, "purchase", 60.0), (3, 4 * MINUTE, None, 7, "view", 1.0), (4, 4 * MINUTE, 65 * MINUTE, 7, "view", 1.0), (5, 1, 62 * MINUTE, 7, "view", 1.0)]
    got = sessions_of(spark, rows, 8)
    assert got == sessions_by_hand(rows)
    assert [x[5] for x in got] == [400, 1]


def test_sessions_of_nothing(spark):
    assert sessions_of(spark, [], 4) == []
    assert sessions_of(spark, [(1, 0, 99 * MINUTE, 3, "view", 1.0)], 4) == []
    with pytest.raises(ValueError, match="no column arrived_at"):
        sessions.sessions(clicks_frame(spark, []).drop("arrived_at"))


def test_sessions_with_other_columns_and_zones(spark):
    rows = odd_clicks(200, 4)
    clash = clicks_frame(spark, rows).withColumns({"rid": F.lit("x"), "late": F.lit("y"), "final": F.lit(1), "part": F.lit(2), "through": F.lit(3)})
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, sessions.sessions(clash).collect())) == sessions_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# -- conversations ------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = out[c]
        if what:
            text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
            mine += [(t, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def repaired_by_hand(rows):
    """Every way of editing, by the state of what is out; (cost, audit) of each state."""
    seen, faults = set(), []
    for role, text in rows:
        rest = text.strip(WHITE)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    to = lambda s, x: {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(x, {}).get(s)

    def better(d, s, x):
        if s is not None and (s not in d or x < d[s]):
            d[s] = x

    def insertions(d):
        for _ in range(4):
            for (s, (cost, audit)), x in itertools.product(list(d.items()), "ua"):
                better(d, to(s, x), (cost + 3, audit + "I"))
        return d

    at = insertions({"": (0, "")})
    for (role, _), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit) in at.items():
            better(new, s, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                better(new, to(s, role[:1]), (cost + extra, audit + "K"))
                for x in "ua":
                    better(new, to(s, x), (cost + extra + 3, audit + "R"))
        at = insertions(new)
    cost, audit = min(at[s] for s in ("", "a") if s in at)
    out, left, state = [], iter(rows), ""
    for e in audit:
        role, text = ({"u": "assistant"}.get(state, "user"), "") if e == "I" else next(left)
        if e == "R":
            role = {"u": "assistant"}.get(state, "user")
        if e != "D":
            out.append(f"{role}:{text}")
            state = role[0]
    return faults, cost, audit, "\n".join(out)


def conversations_by_hand(rows):
    out = []
    for c, mine in damaged_by_hand(rows).items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        known = [t for t, _, _ in mine if t is not None]
        faults, cost, audit, text = repaired_by_hand([x[1:] for x in mine])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "x. ", "a long answer, which goes on."]
    for c in [*range(60), None]:
        for t in range(r.choice([0, 1, 2, 3, 8, 20])):
            rows.append((c, None if r.random() < 0.05 else t + (r.random() < 0.1), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}."))
    return rows


def repaired(spark, tmp_path, rows, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"rid": F.lit(1), "there": F.lit("x"), "part": F.lit(2), "fault": F.lit(3)}).write.parquet(f"{tmp_path}/conversations.parquet")
        got = queries.op13_turn_repair(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
        return sorted(map(tuple, got), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("parts", [1, 5])
def test_repair(spark, tmp_path, parts):
    rows = conversations(parts)
    assert repaired(spark, tmp_path, rows, parts) == conversations_by_hand(rows)


def test_repair_of_one_conversation_in_many_partitions(spark, tmp_path):
    """Most rows are one conversation, spread over partitions of three levels of the tree; and one of one repeated text."""
    r = random.Random(3)
    rows = [(5, i, r.choice(["user", "assistant", "assistant"]), r.choice(["Yes.", f"text {i}.", f"cut {i}", ""])) for i in range(1500)]
    rows += [(6, i, "user", "Again.") for i in range(300)] + [(4, 0, "user", "Hello."), (9, None, None, None)]
    assert repaired(spark, tmp_path, rows, 70) == conversations_by_hand(rows)


def test_repair_of_nothing(spark, tmp_path):
    assert repaired(spark, tmp_path, [], 4) == []


def test_products_are_associative():
    r = random.Random(1)
    for _ in range(200):
        codes = [r.randrange(9) for _ in range(r.randint(1, 12))]
        k = r.randint(0, len(codes))
        whole = turns.of_turns(codes)
        assert whole == turns.times(turns.of_turns(codes[:k]), turns.of_turns(codes[k:]))
        assert whole == turns.product([turns.of_turn(c) for c in codes])


# -- toxicity -----------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    r = random.Random(2)
    terms = ["abc", "abcd", "bcda", "abcdabcdabcd", "ddddd", "aéb", "caaab", "cabab"]
    finder = toxicity.Automaton(terms)
    words = ["".join(r.choices("abcdéx", k=r.randint(1, 14))) for _ in range(3000)] + terms
    for t in terms:  # and words near to terms
        for _ in range(60):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = r.choices("abcdx", k=r.randint(0, 1))
            words.append("".join(w) or "x")
    codes = np.frombuffer(" ".join(words).encode("utf-32-le"), "<u4")
    starts, ends = toxicity.word_places(codes)
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts, ends, strict=True)] == words
    which, term, edits = finder.run(codes, starts, ends)
    got = {int(w): (int(e), int(t)) for w, t, e in zip(which, term, edits, strict=True)}
    for i, w in enumerate(words):
        near = [(d, k) for k, t in enumerate(terms) if (d := distance(w, t)) <= toxicity.edits_allowed(t)]
        assert got.get(i) == min(near, default=None)


def test_words_are_the_same_in_arrays():
    texts = ["a*b c* *d e**f", "x$1 ñandú_o ½ 日本 😀a 𝒜b", "", "*", "it's st@r!", "a&b&c"]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
    starts, ends = toxicity.word_places(codes)
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in toxicity.words_of(t)]


def by_hand(text, term="wretch", weight=4.0):
    model = toxicity.Model([term], [weight], frozenset({"wrench"}), 1.0, -2.0, 99)
    ((hits, counts, words),) = toxicity.Finder(model).hits([text])
    return [(words[i], hits[i][2], round(counts[i], 3)) for i in range(len(hits))]


def test_contexts():
    assert by_hand("such a wretch stood there") == [("wretch", 0, 1.0)]
    assert by_hand("such a wretcj stood there, and far away from it all a retch, too") == [("wretcj", 1, 0.5), ("retch", 1, 0.5)]
    assert by_hand('they wrote "a wretch" in it') == [("wretch", 0, 0.3)]
    assert by_hand("the word wretch is old") == [("wretch", 0, 0.5)]
    assert by_hand("you wretch") == [("wretch", 0, 1.3)]
    assert by_hand("wretch and wretch") == [("wretch", 0, 1.2)] * 2
    assert by_hand("a wrench lies there") == []
    assert by_hand("w*etch") == [("w*etch", 1, 0.5)]


def labelled(spark, n=400):
    """Toxic documents hold terms of a made-up lexicon, others don't; copies, nulls, empty and long texts stand among them."""
    r = random.Random(8)
    vocab = ["".join(r.choices("bdfglmnrst", k=1) + r.choices("aeiou", k=1) + r.choices("bdfglmnrst", k=2) + r.choices("aeiou", k=1)) for _ in range(500)]
    bad = ["zorvix", "quazzle", "vexxor", "jolqué"]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(vocab, k=r.randint(5, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(bad).upper() if r.random() < 0.3 else r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "zorvix quazzle vexxor"), (n, None), (n + 1, ""), (n + 2, "zorvix quazzlee vexxor " + "lo " * 30_000), (n + 3, " ".join(r.choices(vocab, k=50))), rows[0]]
    labels += [(n + 1, None, None), (9999, 1, 1), (None, 0, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"toxic": F.lit("x"), "rid": F.lit(1), "score": F.lit(2), "fold": F.lit(3)})
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(rows[:n])


def test_toxicity(spark):
    docs, labels, _ = labelled(spark)
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == 406
    for x in found:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode() if x.doc_id is not None else b"") % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    by = {x.doc_id: x for x in found}
    wrong = [i for i in range(400) if by[i].predicted != (i % 4 == 0)]
    assert len(wrong) <= 8
    assert by[402].predicted == 1 and by[None].predicted == 1 and not by[400].predicted and not by[401].predicted and not by[403].predicted
    assert {s.edits for s in by[402].spans} == {0, 1}


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(x.doc_id), x.score) for x in toxicity.scored(docs, y).collect()) for y in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    assert {x.predicted for x in toxicity.scored(docs, labels.where("false")).collect()} == {0}
    assert toxicity.scored(docs.where("false"), labels).collect() == []


# -- fertility ----------------------------------------------------------------


def test_fertility_measures_by_hand(spark):
    """Characters per token, byte-fallback share and entropy of tokens, by the libraries alone; and the verdict from the bands."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from quillet.llm import common, fertility

    tok, sp = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeéñßüio", k=r.randint(2, 8))) for _ in range(300)] + ["日本語", "привет", "ƕ", "😀", "a&b"]
    texts = [" ".join(r.choices(vocab, k=n)) for n in (0, 1, 49, 50, 99, 100, 400)] + ["x y " * 60, "日本語 " * 70, "привет мир " * 60, None, " \n ", "same line here\n" * 3]
    rows = [(i, t, r.choice(["en", "de", None, "zz"])) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in fertility.measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t, lang in rows:
        t, x = t or "", got[i]
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        ids = tok.encode(t, add_special_tokens=False).ids
        pieces = [p for w in words for p in sp.encode(w)]
        chars = sum(map(len, words))
        share = sum(sp.is_byte(p) for p in pieces) / max(1, len(pieces))
        counts = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()) if ids else 0.0
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert (x.n_words, x.word_chars, x.n_tokens, x.n_repeat_words) == (len(words), chars, len(ids), len(inside))
        assert x.chars_per_token == pytest.approx(chars / max(1, len(ids))) and x.byte_share == pytest.approx(share) and x.token_entropy == pytest.approx(abs(entropy))
        assert x.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        band = fertility.BANDS[x.band]
        assert x.band == lang if lang in ("en", "de") else x.band in fertility.BANDS
        ok = band.least_chars <= x.chars_per_token <= band.most_chars and x.byte_share <= band.most_bytes and (len(words) < band.min_words or entropy >= band.least_entropy)
        assert x.kept == (not x.base_failed and ok)
