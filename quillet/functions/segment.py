"""Words of scripts that write none: a unigram model learnt from the corpus, and the most likely path through a run.

Runs of a script's characters are cut into words. Candidates are the substrings that repeat; their probabilities are learnt
by expectation maximisation over all runs, counted where they lie (a run that repeats is one row with a count), and words
that hardly anything needs go after each round. At most max_words words are kept, which bounds what a task gets. A run is
then cut at the path with the largest probability (Viterbi), so every character lies in one word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import TOKEN
from quillet.sources.held import held

#: Runs that have no white space between words.
CJK = r"[\x{4e00}-\x{9fff}]+"
#: The log probability of a character that the corpus hasn't shown.
UNKNOWN = -25.0


def best_path(run: str, words: dict[str, float], longest: int) -> list[str]:
    """The words of the most probable cut of a run; ties by the longer last word."""
    score, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for i in range(1, len(run) + 1):
        for n in range(min(longest, i), 0, -1):
            p = words.get(run[i - n : i], UNKNOWN if n == 1 else None)
            if p is not None and score[i - n] + p > score[i]:
                score[i], back[i] = score[i - n] + p, n
    out, i = [], len(run)
    while i:
        out.append(run[i - back[i] : i])
        i -= back[i]
    return out[::-1]


def expected(run: str, words: dict[str, float], longest: int, chances: dict[str, float] | None = None) -> dict[str, float]:
    """How often each word is expected in a run, over all of its cuts by their probability. chances: the words' probabilities, if many runs share them."""
    n = len(run)
    chances = {w: math.exp(p) for w, p in words.items()} if chances is None else chances
    before, behind = [0.0] + [0.0] * n, [0.0] * n + [1.0]
    weights = [[chances.get(run[a:b], math.exp(UNKNOWN) if b == a + 1 else 0.0) for b in range(a + 1, min(n, a + longest) + 1)] for a in range(n)]
    before[0] = 1.0
    scale = [1.0] * (n + 1)  # so that long runs don't underflow
    for i in range(1, n + 1):
        total, carried = 0.0, 1.0
        for k in range(1, min(longest, i) + 1):
            if w := weights[i - k][k - 1]:
                total += before[i - k] * w * carried
            carried /= scale[i - k] if i - k else 1.0
        scale[i] = total or 1.0
        before[i] = total / scale[i]
    for i in range(n - 1, -1, -1):
        carried = 1.0
        for k, w in enumerate(weights[i], 1):
            carried /= scale[i + k]
            if w:
                behind[i] += behind[i + k] * w * carried
    out: dict[str, float] = {}
    for a in range(n):
        carried = 1.0
        for b, w in enumerate(weights[a], a + 1):
            carried /= scale[b]
            if w:
                out[run[a:b]] = out.get(run[a:b], 0.0) + before[a] * w * behind[b] * carried
    return out


class Segmenter:
    """words: log probabilities; script: the pattern of runs that are cut."""

    def __init__(self, words: dict[str, float], longest: int, script: str = CJK):
        self.words, self.longest, self.script = words, longest, script

    @classmethod
    def learn(cls, texts: DataFrame, text_col: str = "text", script: str = CJK, longest: int = 4, rounds: int = 4, max_words: int = 50_000, least: float = 2.0, cohesion: float = 3.0) -> Segmenter:
        """From all texts. longest: characters of a word; least: how often a word of several characters must be expected;
        cohesion: how many times more often it must stand than its parts would meet by chance."""
        found = texts.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(script), 0)).alias("run"))
        # short rows are much work: of a table of few files they'd be few tasks
        spark = texts.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        runs = held(found.groupBy("run").agg(F.count("*").alias("n")).repartition(parts, F.xxhash64("run")), "runs")
        n = F.length("run")
        places = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring(F.col("run"), i, k))))
        counts = runs.select(F.explode(places).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {least} or length(word) = 1")
        counts = held(counts, "counts")
        size = runs.agg(F.sum(F.col("n") * n)).first()[0] or 0
        # a word holds together: it is more frequent than each two parts of it would meet by chance
        halves = counts.where("length(word) > 1").select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
        halves = halves.select("word", "n", F.expr("substring(word, 1, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
        of = lambda x: counts.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
        bound = halves.join(of("a"), "a").join(of("b"), "b").groupBy("word").agg(F.min(F.col("n") * size / (F.col("n_a") * F.col("n_b"))).alias("bound")).where(F.col("bound") >= cohesion)
        counts = counts.join(bound.select("word", F.lit(True).alias("bound")), "word", "left").where("bound or length(word) = 1")
        first = counts.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(max_words).collect()
        total = sum(r.n for r in first) or 1
        words = {r.word: math.log(r.n / total) for r in first}
        for _ in range(rounds if words else 0):
            now = words

            def count(batches: Iterator[pa.RecordBatch], now: dict[str, float] = now) -> Iterator[pa.RecordBatch]:
                sums: dict[str, float] = {}
                chances = {w: math.exp(p) for w, p in now.items()}
                for batch in batches:
                    for run, k in zip(batch.column("run").to_pylist(), batch.column("n").to_pylist(), strict=True):
                        for w, e in expected(run, now, longest, chances).items():
                            sums[w] = sums.get(w, 0.0) + k * e
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.float64())})

            got = runs.mapInArrow(count, "word string, n double").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n").between(least, 1e300) | (F.length("word") == 1)).collect()  # max_words rows, about
            got = [r for r in got if r.n > 0]
            total = sum(r.n for r in got)
            words = {r.word: math.log(r.n / total) for r in got}
        return cls(words, longest, script)

    def cut(self, run: str) -> list[str]:
        return best_path(run, self.words, self.longest)

    def __call__(self, text: Column) -> Column:
        """For keywords(): the words of a text column, runs of the script cut, other tokens as they are."""
        words, longest = self.words, self.longest

        @F.pandas_udf("array<string>")
        def cut_all(tokens: pd.Series, inside: pd.Series) -> pd.Series:
            known: dict[str, list[str]] = {}

            def cut(t: str) -> list[str]:
                if t not in known:
                    known[t] = best_path(t, words, longest)
                return known[t]

            return pd.Series([None if ts is None else [w for t, ok in zip(ts, oks, strict=True) for w in (cut(t) if ok else [t])] for ts, oks in zip(tokens, inside, strict=True)])

        tokens = F.regexp_extract_all(text, F.lit(f"{self.script}|{TOKEN}"), 0)
        return cut_all(tokens, F.transform(tokens, lambda t: t.rlike(f"^(?:{self.script})$")))
