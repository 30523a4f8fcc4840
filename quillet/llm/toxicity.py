"""Toxicity: a learnt lexicon, misspellings by a Levenshtein automaton, and contexts that tell quotation from abuse.

The lexicon is learnt from labelled rows: words whose odds of standing in a toxic document are high. Its trie is intersected
with the Levenshtein automaton of bounded edits: a state is a set of (trie node, edits so far), made deterministic when it
is first reached. All words of a batch run through that automaton at once, a character a step, and most are dead after
three. A misspelling counts half, unless it is a word that clean documents use. A hit in a window of quotation (quotation
marks around it, words of reporting near it) counts little, one that addresses somebody or stands beside others counts
more. A logistic curve, fitted on folds whose rows the lexicon hasn't seen, turns the sum over distinct terms into a score.

Bounds, all parameters of train(): max_rows labelled rows (by hash, all sources and languages alike), max_candidates words
looked at, max_terms terms and max_likes look-alikes kept. So the model's size doesn't grow with the corpus, and it is what
tasks get. Scoring reads every whole text.

Odd input: null and empty texts have no words and the lowest score. A null doc_id has no label and counts as held out.
Labels that are null or of no document, and repeated labels of a document, are taken as they come. Without a toxic or
without a clean training row all scores are 0. Equal texts have equal scores.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import column_of, keyed, memories, stage

#: Signs that stand for letters when letters are on both sides.
MASKS = "*@$!#%&+"
_WORD = re.compile(rf"[^\W_]+(?:[{re.escape(MASKS)}][^\W_]+)*")
FOLDS = 4
#: What a hit counts by edits, and by its context.
BY_EDITS = (1.0, 0.5, 0.35)
QUOTED, REPORTED, ADDRESSED, CROWDED = 0.3, 0.5, 1.3, 1.2
WINDOW = 6
_OPENING, _CLOSING = "\"“«„‹", "\"”»“›"
_report = re.compile(r"\b(?:said|says|called|wrote|quote[ds]?|word|term|according|insult(?:ed|s)?|dit|mot|appelé|selon|sagte|wort|nannte|laut|dijo|palabra|llamó|según)\b").search
_address = re.compile(r"\b(?:you|your|you're|u|vous|votre|toi|euch|dich|usted|ustedes|eres)\b").search


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of a lower-cased text; a masking sign between two of them belongs to the word."""
    return _WORD.findall(text)


def edits_allowed(term: str) -> int:
    """None below four characters, one from there, two from twelve."""
    return 0 if len(term) < 4 else 1 if len(term) < 12 else 2


class Automaton:
    """The lexicon's trie times the Levenshtein automaton, deterministic, built as far as words lead."""

    DEAD, START = 0, 1

    def __init__(self, terms: list[str]):
        self.children, self.term, self.allowed = [{}], [-1], [0]
        self.budget = [edits_allowed(t) for t in terms]
        for i, t in enumerate(terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], self.budget[i])
            for ch in t:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.allowed.append(0)
                node = nxt
                self.allowed[node] = max(self.allowed[node], self.budget[i])
            self.term[node] = i
        alphabet = sorted({ch for t in terms for ch in t})
        self.letters = ["", *alphabet]  # 0: any other character
        self.code = np.zeros(1 << 16, np.int32)
        for k, ch in enumerate(alphabet, 1):
            if ord(ch) < 1 << 16:
                self.code[ord(ch)] = k
        self.ids, self.sets, self.found = {frozenset(): 0}, [frozenset()], [(-1, 0)]
        self.table = np.full((64, len(self.letters)), -1, np.int32)
        self.table[0] = 0
        self.state(self.closed({0: 0}))

    def closed(self, nodes: dict[int, int]) -> frozenset:
        """With the deletions of the term's next characters; of each node the fewest edits."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node) == e:
                for nxt in self.children[node].values():
                    if e + 1 <= self.allowed[nxt] and e + 1 < nodes.get(nxt, 99):
                        nodes[nxt] = e + 1
                        todo.append((nxt, e + 1))
        return frozenset(nodes.items())

    def state(self, s: frozenset) -> int:
        k = self.ids.get(s)
        if k is None:
            k = self.ids[s] = len(self.sets)
            self.sets.append(s)
            ends = [(e, self.term[n]) for n, e in s if self.term[n] >= 0 and e <= self.budget[self.term[n]]]
            e, t = min(ends, default=(0, -1))
            self.found.append((t, e))
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return k

    def step(self, state: int, letter: int) -> int:
        out: dict[int, int] = {}
        ch = self.letters[letter]
        for node, e in self.sets[state]:
            for c, nxt in self.children[node].items():
                cost = e if c == ch else e + 1
                if cost <= self.allowed[nxt] and cost < out.get(nxt, 99):
                    out[nxt] = cost
            if e + 1 <= self.allowed[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
        to = self.state(self.closed(out))
        self.table[state, letter] = to
        return to

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words at starts to ends in an array of code points: which ones are hits, their terms and edits."""
        letters = self.code[np.minimum(codes, 0xFFFF)]
        state, at = np.full(len(starts), self.START, np.int32), starts.copy()
        which, hits = np.arange(len(starts)), []
        while len(which):
            over = at == ends[which]
            if over.any():
                hits.append((which[over], state[over]))
                which, at, state = which[~over], at[~over], state[~over]
            letter = letters[at]
            new = self.table[state, letter]
            if len(new) and new.min() < 0:
                for s, c in {*zip(state[new < 0].tolist(), letter[new < 0].tolist(), strict=True)}:
                    self.step(s, c)
                new = self.table[state, letter]
            alive = new != self.DEAD
            which, at, state = which[alive], at[alive] + 1, new[alive]
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        which, state = (np.concatenate(x) for x in zip(*hits, strict=True))
        term, edits = np.array(self.found).T
        ok = term[state] >= 0
        order = np.argsort(which[ok], kind="stable")
        return which[ok][order], term[state[ok]][order], edits[state[ok]][order]


_alnum = np.zeros((1 << 16) + 1, bool)  # the last: all code points beyond
_masks = np.zeros((1 << 16) + 1, bool)


def classes() -> tuple[np.ndarray, np.ndarray]:
    if not _masks.any():
        _alnum[:-1] = [chr(i).isalnum() for i in range(1 << 16)]
        _masks[[ord(c) for c in MASKS]] = True
    return _alnum, _masks


def word_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of words_of start and end in an array of code points."""
    alnum, masks = classes()
    small = np.minimum(codes, 1 << 16)
    inside = alnum[small]
    beyond = np.flatnonzero(codes > 0xFFFF)
    if len(beyond):
        inside[beyond] = [chr(c).isalnum() for c in codes[beyond].tolist()]
    middle = np.flatnonzero(inside[:-2] & masks[small[1:-1]] & inside[2:]) + 1
    inside[middle] = True
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def context(text: str, start: int, end: int, before: str, after: str, crowd: int) -> float:
    """What a hit counts where it stands; before, after: the windows' characters on either side of it."""
    factor = 1.0
    opened = max(before.rfind(c) for c in _OPENING)
    if opened >= 0 and any(c in after for c in _CLOSING) and (before[opened] != '"' or before.count('"') % 2):
        factor = QUOTED
    elif _report(before):
        factor = REPORTED
    elif _address(before) or _address(after):
        factor = ADDRESSED
    return factor * (CROWDED if crowd > 1 else 1.0)


@dataclasses.dataclass
class Model:
    terms: list[str] = dataclasses.field(default_factory=list)
    weights: list[float] = dataclasses.field(default_factory=list)
    likes: frozenset = frozenset()  # words within the edits of a term that clean documents use
    slope: float = 0.0
    bias: float = -50.0
    number: int = 0


def strengths(text: str, starts: list[int], ends: list[int], hits: list[tuple[int, int, int]]) -> list[float]:
    """What each hit (word number, term, edits) counts, by edits and context; starts, ends: of the text's words."""
    out, at = [], [w for w, _, _ in hits]
    for i, (w, _, e) in enumerate(hits):
        lo, hi = max(0, w - WINDOW), min(len(starts) - 1, w + WINDOW)
        crowd = 1 + sum(abs(at[j] - w) <= WINDOW for j in (i - 1, i + 1) if 0 <= j < len(at))
        before, after = text[starts[lo - 1] if lo else 0 : starts[w]], text[ends[w] : ends[hi]] if hi < len(ends) - 1 else text[ends[w] :][:400]
        out.append(BY_EDITS[e] * context(text, starts[w], ends[w], before[-400:], after[:400], crowd))
    return out


def total(model: Model, hits: list[tuple[int, int, int]], strength: list[float]) -> float:
    """The sum over distinct terms of weight times the strongest hit."""
    best: dict[int, float] = {}
    for (_, t, _), s in zip(hits, strength, strict=True):
        best[t] = max(best.get(t, 0.0), s)
    return sum(model.weights[t] * s for t, s in best.items())


class Finder:
    """The model's automaton, and hits of texts."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms)

    def hits(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[float], list[str]]]:
        """For each lower-cased text its hits (word number, term, edits), their strengths and words."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts, ends = word_places(codes)
        which, term, edits = self.automaton.run(codes, starts, ends)
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cut = np.searchsorted(starts, first)
        of = np.searchsorted(starts[which], first)
        out = []
        for i, text in enumerate(texts):
            a, b = of[i], of[i + 1]
            if a == b:
                out.append(([], [], []))
                continue
            s, e = (starts[cut[i] : cut[i + 1]] - first[i]).tolist(), (ends[cut[i] : cut[i + 1]] - first[i]).tolist()
            own = [(w, t, k) for w, t, k in zip((which[a:b] - cut[i]).tolist(), term[a:b].tolist(), edits[a:b].tolist(), strict=True) if not k or text[s[w] : e[w]] not in self.model.likes]
            out.append((own, strengths(text, s, e, own), [text[s[w] : e[w]] for w, _, _ in own]))
        return out


_finders: dict[int, Finder] = {}
memories.append(_finders)


def finder(model: Model) -> Finder:
    if model.number not in _finders:
        _finders.clear()
        _finders[model.number] = Finder(model)
    return _finders[model.number]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 512, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows and bytes of a column at most, but a row at least."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
    a, have = 0, 0
    for i, n in enumerate(sizes):
        if i > a and (have + n > most or i - a >= rows):
            yield batch.slice(a, i - a)
            a, have = i, 0
        have += n
    if batch.num_rows > a:
        yield batch.slice(a)


# -- training ---------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic, fold of at most about max_rows labelled rows that aren't held out, chosen by a hash of doc_id."""
    known = keyed(labels, doc_id="doc_id", toxic="toxic").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").dropDuplicates()
    share = min(1.0, max_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(1 << 30))
    known = known.withColumn("place", place).where(F.col("place") < int(share * (1 << 30)))
    rows = keyed(docs, doc_id="doc_id", text="text").select("doc_id", "text")
    # max_rows ids at most, so they are sent to the texts rather than all texts to them
    return rows.join(F.broadcast(known), "doc_id").select(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), F.col("toxic").cast("int").alias("toxic"), (F.col("place") % FOLDS).cast("int").alias("fold"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """word, t0.., c0..: in how many toxic and clean documents of each fold it stands; near copies of one toxic document count once.

    Copies share the smallest hash of their words most of the time, so toxic documents are told apart by it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("fold", pa.int32()), ("sketch", pa.int64()), ("clean", pa.int64())])
        for whole in batches:
            for batch in slices(whole):
                toxic, clean = [], [Counter() for _ in range(FOLDS)]
                for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                    found = set(words_of(text))
                    if label and found:
                        sketch = min(map(digest, found))
                        toxic += [(w, fold, sketch) for w in found]
                    else:
                        clean[fold].update(found)
                rows = [(w, f, s, 0) for w, f, s in toxic] + [(w, f, None, n) for f, c in enumerate(clean) for w, n in c.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    counts = rows.mapInArrow(count, "word string, fold int, sketch bigint, clean bigint")
    per = counts.groupBy("word", "fold", "sketch").agg(F.sum("clean").alias("clean"))
    each = [F.count_if((F.col("fold") == f) & F.col("sketch").isNotNull()).alias(f"t{f}") for f in range(FOLDS)] + [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("clean"))), F.lit(0)).alias(f"c{f}") for f in range(FOLDS)]
    return per.groupBy("word").agg(*each)


def digest(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def log_odds(t, c, n_toxic, n_clean):
    return np.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's method."""
    a, b = 0.0, float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, max_candidates: int = 20_000, max_terms: int = 5_000, max_likes: int = 50_000) -> Model:
    """The model, from labelled rows of docs that aren't held out. What comes to the driver is bounded by the parameters."""
    rows = stage(sample(docs, labels, max_rows), "labelled")
    n = {(r.toxic, r.fold): r.n for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}  # 2 x FOLDS rows
    n_toxic, n_clean = ([n.get((k, f), 0) for f in range(FOLDS)] for k in (1, 0))
    if not sum(n_toxic) or not sum(n_clean):
        return Model()
    words = stage(vocabulary(rows), "vocabulary")
    t, c = (sum(F.col(f"{k}{f}") for f in range(FOLDS)) for k in "tc")
    odds = F.log(((t + 0.5) / (sum(n_toxic) + 1)) / ((c + 0.5) / (sum(n_clean) + 1)))
    likely = words.withColumn("odds", odds).where((t >= 2) & (odds >= 2.0)).orderBy(F.desc(odds * F.sqrt(t)), "word").limit(max_candidates).collect()
    if not likely:
        return Model()
    number = {r.word: i for i, r in enumerate(likely)}
    ts, cs = (np.array([[r[f"{k}{f}"] for f in range(FOLDS)] for r in likely], float) for k in "tc")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates of each labelled document, and what their hits count."""
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text in batch.column("text").to_pylist():
                    best: dict[int, float] = {}
                    places = [m.span() for m in _WORD.finditer(text)]
                    hits = [(w, number[text[a:b]], 0) for w, (a, b) in enumerate(places) if text[a:b] in number]
                    if hits:
                        starts, ends = map(list, zip(*places, strict=True))
                        for (_, k, _), s in zip(hits, strengths(text, starts, ends, hits), strict=True):
                            best[k] = max(best.get(k, 0.0), s)
                    out.append(best)
                yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "fold": batch.column("fold"), "terms": pa.array([list(b) for b in out], pa.list_(pa.int32())), "factors": pa.array([list(b.values()) for b in out], pa.list_(pa.float32()))})

    seen = rows.mapInArrow(present, "toxic int, fold int, terms array<int>, factors array<float>").toArrow()  # max_rows rows
    y, fold = seen.column("toxic").to_numpy().astype(float), seen.column("fold").to_numpy()
    lists = seen.column("terms").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    doc, term, factor = np.repeat(np.arange(len(y)), size), lists.flatten().to_numpy(), seen.column("factors").combine_chunks().flatten().to_numpy()
    # of each fold's rows the sums by the lexicon of the other folds; the cut of the odds is the one that predicts best
    total_t, total_c = ts.sum(1), cs.sum(1)
    apart = np.stack([log_odds(total_t - ts[:, f], total_c - cs[:, f], sum(n_toxic) - n_toxic[f], sum(n_clean) - n_clean[f]) for f in range(FOLDS)], 1)
    support = np.stack([total_t - ts[:, f] for f in range(FOLDS)], 1)
    best = None
    for least in np.arange(2.0, 7.01, 0.25):
        for few in (2, 3, 5):
            use = (apart >= least) & (support >= few)
            x = np.bincount(doc, np.where(use, apart, 0)[term, fold[doc]] * factor, len(y))
            a, b = logistic(x, y)
            loss = -np.mean(np.log(np.clip(np.where(y > 0, 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))), 1 / (1 + np.exp(np.clip(a * x + b, -30, 30)))), 1e-6, 1)))
            if a > 0 and (best is None or loss < best[0] - 1e-9):
                best = loss, least, few, a, b
    if best is None:
        return Model()
    _, least, few, slope, bias = best
    whole = log_odds(total_t, total_c, sum(n_toxic), sum(n_clean))
    chosen = [i for i in range(len(likely)) if whole[i] >= least and total_t[i] >= few][:max_terms]
    terms = [likely[i].word for i in chosen]
    model = Model(terms, [float(whole[i]) for i in chosen], frozenset(), slope, bias, digest("\n".join(terms)))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(model)
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, (h, _, _) in zip(words, f.hits(words), strict=True) if h and h[0][2] > 0], pa.string())})

    used = words.where(c > 0).select("word").mapInArrow(alike, "word string").orderBy("word").limit(max_likes)
    return dataclasses.replace(model, likes=frozenset(r.word for r in used.collect()), number=digest("\n".join([*terms, "likes"])))


RESULT = "rid bigint, doc_id bigint, score double, spans array<struct<term:string,word:string,edits:int,place:bigint,counts:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of RESULT for each row: score from 0 to 1, and the hits with their word numbers and what they count."""
    rows = keyed(docs, doc_id="doc_id", text="text").select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    span = pa.struct([("term", pa.string()), ("word", pa.string()), ("edits", pa.int32()), ("place", pa.int64()), ("counts", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(model)
        for whole in batches:
            for batch in slices(whole):
                found = f.hits(batch.column("text").to_pylist())
                z = np.array([model.slope * total(model, h, s) + model.bias for h, s, _ in found])
                spans = [[{"term": model.terms[t], "word": w, "edits": k, "place": p, "counts": s * model.weights[t]} for (p, t, k), s, w in zip(h, st, ws, strict=True)] for h, st, ws in found]
                yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))), "spans": pa.array(spans, pa.list_(span))})

    return rows.mapInArrow(look, RESULT)


def scored(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of docs, by a model of its labelled rows."""
    for c in ("doc_id", "text"):
        if column_of(docs, c) is None:
            raise ValueError(f"the table has no column {c}")
    found = score(docs, train(docs, labels, **bounds))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
