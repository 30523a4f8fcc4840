"""Quality rules: tokeniser fertility, with rejection bands per language or script, beside counts of words and repeats.

Two public vocabularies measure a text. The byte-level one gives characters per token and the entropy of the text's
tokens; the one with byte fallback gives the share of its pieces that are single bytes. Prose in a language that a
vocabulary knows lies in a narrow band; text that a vocabulary splits into crumbs, never splits, or says with a few
tokens again and again lies outside.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.common import column_of, keyed, memories, release_above, words_of
from quillet.llm.token_files import shared_tokens


class Band(NamedTuple):
    """Limits of what is kept. entropy counts for texts of at least min_words words only, as a short text has few tokens."""

    least_chars: float  # characters per token of the byte-level vocabulary
    most_chars: float
    most_bytes: float  # share of byte-fallback pieces
    least_entropy: float  # bits per token
    min_words: int = 100


#: The four languages' lower limits lie 6 to 9 % (characters) and 15 % (entropy) below the least of 966 documents labelled good.
#: By language if the table names it, else by the script that most letters have. Texts without letters have the band "".
BANDS = {
    "en": Band(1.85, 9.0, 0.10, 4.8),
    "de": Band(1.75, 9.0, 0.10, 4.8),
    "fr": Band(1.6, 9.0, 0.10, 4.8),
    "es": Band(1.5, 9.0, 0.10, 4.8),
    "latin": Band(1.2, 9.0, 0.15, 3.0),
    "cyrillic": Band(0.5, 9.0, 0.30, 3.0),
    "greek": Band(0.4, 9.0, 0.40, 3.0),
    "arabic": Band(0.4, 9.0, 0.60, 3.0),
    "hebrew": Band(0.4, 9.0, 0.60, 3.0),
    "cjk": Band(0.3, 9.0, 0.70, 3.0),
    "other": Band(0.2, 9.0, 0.95, 3.0),
    "": Band(1.1, 9.0, 0.50, 2.0),
}
#: Ranges of letters by script.
SCRIPTS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ɏ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽ",
    "arabic": "؀-ۿ",
    "hebrew": "֐-׿",
    "cjk": "぀-ヿ㐀-鿿가-힣",
}
_script = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
#: A worker that has filtered a partition may wait while later stages need the executor's memory; it keeps so much at most.
WAITING_MB = 320
_letter = re.compile(r"[^\W\d_]")
SYMBOLS = "#*$%&|<>"
LANGUAGES = frozenset(BANDS) - {*SCRIPTS, "other", ""}
RESULT = "rid bigint, doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, band string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, kept boolean"


def script_of(text: str) -> str:
    """The script that most letters of the text have; "" if it has no letters."""
    if not (letters := _letter.findall(text)):
        return ""
    joined = "".join(letters)
    counts = {k: len(p.findall(joined)) for k, p in _script.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 > len(letters) else "other"


class Pieces:
    """How many pieces and byte pieces a word has under a sentencepiece model; each new word is encoded once."""

    def __init__(self, path: str, memory: int = 600_000):
        from sentencepiece import SentencePieceProcessor

        self.model, self.memory = SentencePieceProcessor(model_file=path), memory
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.index, self.counts = {}, np.zeros((0, 2), np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, and the table of (pieces, byte pieces) by place."""
        if len(self.index) + len(words) > self.memory and len(self.index) > self.memory // 2:
            n = self.memory // 4  # frequent words come early
            self.index, self.counts = dict(itertools.islice(self.index.items(), n)), self.counts[:n]
        place = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            missing = [words[i] for i in unknown.tolist()]
            new, n = list(dict.fromkeys(missing)), len(self.index)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            got = self.model.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            is_byte = self.byte[np.fromiter(itertools.chain.from_iterable(got), np.int64, int(sizes.sum()))]
            self.counts = np.concatenate([self.counts, np.stack([sizes, np.bincount(np.repeat(np.arange(len(got)), sizes), is_byte, len(got)).astype(np.int64)], 1)])
            place[unknown] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        return place, self.counts


_pieces: dict[str, Pieces] = {}
memories.append(_pieces)


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in windows of 3 words that the sequence has twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:  # three of them fit one number
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] << 32 | ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    start = np.flatnonzero(counts[at] > 1)
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[start + k] = True
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the ids' own distribution."""
    if not len(ids):
        return 0.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return max(0.0, float(-(p * np.log2(p)).sum()))


class Judge:
    """The measures of texts and what the rules say of them: the columns of RESULT from n_words on."""

    def __init__(self, tokenizer: str, pieces: str, bands: dict[str, Band] = BANDS, min_words: int = 50):
        if pieces not in _pieces:
            _pieces[pieces] = Pieces(pieces)
        self.tokens, self.pieces, self.bands, self.min_words = shared_tokens(tokenizer), _pieces[pieces], bands, min_words

    def __call__(self, texts: list[str], langs: list[str | None]) -> list[tuple]:
        words = [words_of(t) for t in texts]
        at, counts = self.pieces.of([w for x in words for w in x])
        ends, bands, out = np.cumsum([len(x) for x in words]), self.bands, []
        for t, x, ids, end, lang in zip(texts, words, self.tokens.encode(texts), ends, langs, strict=True):
            mine = at[end - len(x) : end]
            chars = sum(map(len, x))
            n_pieces, n_bytes = (int(v) for v in counts[mine].sum(0))
            repeat = repeated_words(mine)
            failed = len(x) < self.min_words or 100 * repeat > 50 * len(x)
            name = lang if lang in bands and (lang in LANGUAGES or lang not in BANDS) else script_of(t)
            if name not in bands:
                name = "other"
            b, e = bands[name], entropy(ids)
            rate, share = chars / max(1, len(ids)), n_bytes / max(1, n_pieces)
            inside = b.least_chars <= rate <= b.most_chars and share <= b.most_bytes and (len(x) < b.min_words or e >= b.least_entropy)
            out.append((len(x), chars, sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeat, failed, name, len(ids), rate, share, e, not failed and inside))
        return out


def measure(docs: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS, min_words: int = 50) -> DataFrame:
    """One row per row of docs: the columns of RESULT.

    Null text: no words, so base_failed. base_failed: fewer than min_words words, or more than half of the words in
    3-word windows found twice or more. kept: not base_failed, and every measure in the band of the text's language
    (lang_col, if it is there and names one that bands has; the empty string and names of scripts are no languages) or
    else of its script. Texts of any length are read whole; equal rows are judged alike; other columns are not read.
    """
    rows = keyed(docs, ("lang",), doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.selectExpr("rid", "cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(tokenizer, pieces, bands, min_words)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                out = of([t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist())
                names = [f.split()[0] for f in RESULT.split(", ")][2:]
                cols = dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "doc_id": batch.column("doc_id")} | cols)

    return rows.mapInArrow(judge, RESULT)


def kept_documents(docs: DataFrame, tokenizer: str, pieces: str, text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, judged as measure does, in one pass without a shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, lang = (names[docs.columns.index(c)] if (c := column_of(docs, x)) else None for x in (text_col, lang_col))
    if text is None:
        raise ValueError(f"the table has no column {text_col}")
    plain = docs.toDF(*names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(tokenizer, pieces, **how)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = [t or "" for t in batch.column(text).cast(pa.string()).to_pylist()]
                langs = batch.column(lang).cast(pa.string()).to_pylist() if lang else [None] * len(texts)
                yield batch.filter(pa.array([x[-1] for x in of(texts, langs)], pa.bool_()))
        release_above(WAITING_MB)

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
