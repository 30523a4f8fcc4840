"""Packing documents into sequences by lexical retrieval.

The documents are dealt into shards of about `shard_bytes` (6 MB) of text, each with its own BM25 inverted index, by what
words they have: a document's key is the words that win two races of all its words, in which a word's speed is the square
of its length (long words are rare); documents are range-partitioned by key, and the sorted rows of a range are cut into
shards. So documents with rare words in common, in the same language at least, lie in one shard at any size of the
corpus. Rows with equal keys are spread by a hash, so a hot key is many shards.

A seed document opens a window; its unused neighbours by BM25 over all its words fill it: those that fit whole in order
of score, then the best of the others, cut where the window ends. The rest of a cut document opens the next window
and is its seed. If a seed has no unused neighbour left, the next unused document follows it. So all windows of a shard are
full but the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import keyed, row_bytes, word_hashes, word_starts
from quillet.llm.token_files import shared_tokens

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_piece = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


#: Odd factors; the highest bits of their products with a word's hash are its luck in the races.
RACES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: What a row counts towards a shard's size besides its text, so that many empty texts are many shards, too.
ROW_BYTES = 64
#: Lists of up to so many postings are read by one index, longer ones as slices.
SHORT_LIST = 64


def lexical_keys(texts: pa.Array) -> np.ndarray:
    """Two 64-bit keys for each text: the hashes of the words that come first in two races; 0 without words."""
    data, offsets = row_bytes(texts)
    starts, ends, rows = word_starts(data, offsets)
    words, out = word_hashes(data, starts, ends), np.zeros((len(rows) - 1, 2), np.int64)
    full = np.flatnonzero(np.diff(rows))
    if not len(full):
        return out
    slow = 1.0 / np.minimum(ends - starts, 20).astype(np.float64) ** 2
    for k in (0, 1):
        time = (words * np.uint64(RACES[k]) >> np.uint64(11)).astype(np.float64) * slow
        first = np.flatnonzero(time == np.repeat(np.minimum.reduceat(time, rows[full]), np.diff(rows)[full]))
        row = np.searchsorted(rows, first, "right") - 1
        row, at = np.unique(row, return_index=True)
        out[row, k] = words[first[at]].view(np.int64)
    return out


class Index:
    """A BM25 inverted index over the words of a shard's texts."""

    def __init__(self, texts: pa.Array, k1: float = 1.5, b: float = 0.75):
        data, offsets = row_bytes(texts)
        starts, ends, rows = word_starts(data, offsets)
        self.n = len(rows) - 1
        sizes = np.diff(rows)
        # a word is the highest bits of its hash; document and word, or word and place, fit one number, so plain sorts do
        bits = max(1, len(starts).bit_length(), self.n.bit_length())
        width = 63 - bits
        word = word_hashes(data, starts, ends) >> np.uint64(64 - width)
        del starts, ends
        pair = np.repeat(np.arange(self.n), sizes) << width | word.astype(np.int64)
        del word
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, tf = pair[first], np.diff(np.append(first, len(pair)))
        doc = pair >> width
        by_term = np.sort((pair & (1 << width) - 1) << bits | np.arange(len(pair)))
        new = np.flatnonzero(np.diff(by_term >> bits, prepend=-1))
        by_term &= (1 << bits) - 1
        of_term = np.append(new, len(by_term))
        df = np.diff(of_term)
        term = np.empty(len(pair), np.int64)
        term[by_term] = np.repeat(np.arange(len(df)), df)
        idf = np.log((self.n - df + 0.5) / (df + 0.5) + 1)
        norm = (k1 * (1 - b + b * sizes / max(1.0, sizes.mean() if self.n else 1.0)))[doc]
        weight = idf[term] * tf * (k1 + 1) / (tf + norm)
        self.of_doc = np.searchsorted(doc, np.arange(self.n + 1)).tolist()
        self.term = np.where(df[term] > 1, term, -1)  # a word of one document alone finds nothing
        self.of_term, self.posting_doc, self.posting_weight = of_term, doc[by_term], weight[by_term]

    def compact(self, used: np.ndarray) -> None:
        """Leave out the postings of documents that are used."""
        free = ~used[self.posting_doc]
        self.of_term = np.concatenate([[0], np.cumsum(free)])[self.of_term]
        self.posting_doc, self.posting_weight = self.posting_doc[free], self.posting_weight[free]

    def neighbours(self, seed: int, used: np.ndarray, first: int = 48) -> Iterator[np.ndarray]:
        """Unused documents that share a word with the seed, best score first, ties by place; the `first` ones (and ties) come ahead."""
        t = self.term[self.of_doc[seed] : self.of_doc[seed + 1]]
        t = t[t >= 0]
        if not len(t):
            return
        start, end = self.of_term[t], self.of_term[t + 1]
        few = end - start <= SHORT_LIST
        size, spans = (end - start)[few], list(zip(start[~few].tolist(), end[~few].tolist(), strict=True))
        at = np.repeat(start[few] - np.cumsum(size) + size, size) + np.arange(size.sum())
        docs, weights = (np.concatenate([x[at], *(x[a:b] for a, b in spans)]) for x in (self.posting_doc, self.posting_weight))
        total = np.bincount(docs, weights, self.n)
        total[used] = 0
        found = np.flatnonzero(total)
        score = total[found]
        least = np.partition(score, len(score) - first)[len(score) - first] if len(score) > first else 0.0
        for part in (score >= least, score < least):
            mine = found[part]
            yield mine[np.argsort(-score[part], kind="stable")]


def fill(sizes: np.ndarray, index: Index, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once."""
    n, used = len(sizes), np.zeros(len(sizes), bool)
    out, sequence, filled, following, n_used = [], 0, 0, 0, [0]

    def put(doc: int, start: int) -> int:
        """Place doc from start on, into as many windows as it needs; the tokens of it in the open window."""
        nonlocal sequence, filled
        used[doc] = True
        n_used[0] += 1
        while start < sizes[doc]:
            take = int(min(length - filled, sizes[doc] - start))
            out.append((doc, start, take, sequence, filled))
            start, filled = start + take, filled + take
            if filled == length:
                sequence, filled, take = sequence + 1, 0, 0
        return filled

    compact_at = n // 2
    while following < n:
        if used[following]:
            following += 1
            continue
        seed = following
        put(seed, 0)
        while filled:
            if n_used[0] >= compact_at:
                index.compact(used)
                compact_at = n - (n - compact_at) // 2
            cut = -1
            for near in index.neighbours(seed, used):
                size, at = sizes[near], 0
                while filled and at < len(near):
                    fits = np.flatnonzero(size[at:] <= length - filled)
                    k = at + int(fits[0]) if len(fits) else len(near)
                    if cut < 0 and k > at:
                        cut = int(near[at])  # the best of those that don't fit
                    if k < len(near):
                        put(int(near[k]), 0)
                    at = k + 1
                if not filled:
                    break
            if not filled or cut < 0:
                break
            put(cut, 0)
            seed = cut
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 2048, shard_bytes: int = 6 << 20, lexical: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's tokens are the ids of its whole text and end_id; null and empty texts have end_id alone. Each token
    lies in exactly one piece; pieces of a sequence follow each other without gaps from offset 0; a sequence has
    length tokens, and only the last one of each shard may have fewer. Equal rows are packed each. sequence_id: the range
    and the number in it. An empty table gives no rows; other columns are not read. shard_bytes: a shard ends with the
    document that reaches so many bytes, of which a row counts 64 besides its text. lexical: deal documents by their words, not at random.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).selectExpr("rid", "cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES)).first()[0] or 0
    ranges = max(1, -(-total // (4 * shard_bytes)))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("k0", pa.int64()), ("k1", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 128):  # what is made of them stays in the cache
                batch = whole.slice(a, 128)
                keys = lexical_keys(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "text")), pa.array(keys[:, 0]), pa.array(keys[:, 1])], schema=schema)

    if lexical:
        rows = rows.mapInArrow(deal, "rid bigint, doc_id bigint, text string, k0 bigint, k1 bigint")
    else:
        rows = rows.withColumns({"k0": F.lit(0).cast("long"), "k1": F.lit(0).cast("long")})
    keys = [F.col("k0"), F.col("k1"), F.xxhash64("rid", "doc_id")]
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def one(ids: list, texts: pa.Array, sequence: int) -> pa.RecordBatch:
        tokens, end, coded = shared_tokens(tokenizer), np.asarray([end_id], np.uint32), []
        for a in range(0, len(ids), 64):
            coded += [np.concatenate([x, end]) for x in tokens.encode(texts.slice(a, 64).to_pylist())]
        sizes = np.array([len(x) for x in coded])
        pieces = fill(sizes, Index(texts), length)
        cols = list(zip(*pieces, strict=True))
        data = [coded[d][s : s + k].astype("<u4").tobytes() for d, s, k, _, _ in pieces]
        arrays = [[ids[d] for d in cols[0]], cols[1], cols[2], [int(sizes[d]) for d in cols[0]], [sequence + q for q in cols[3]], cols[4], data]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, _piece, strict=True)], schema=_piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for whole in batches:
            a, lengths = 0, pc.binary_length(whole.column("text")).to_numpy() + ROW_BYTES
            while a < whole.num_rows:
                left = np.cumsum(lengths[a:])
                n = min(len(left), int(np.searchsorted(left, shard_bytes - size)) + 1)
                ids += whole.column("doc_id").slice(a, n).to_pylist()
                texts.append(whole.column("text").slice(a, n).cast(pa.large_string()))
                size, a = size + int(left[n - 1]), a + n
                if size >= shard_bytes:
                    yield (out := one(ids, pa.concat_arrays(texts), sequence))
                    sequence, ids, texts, size = out.column("sequence_id")[-1].as_py() + 1, [], [], 0
        if ids:
            yield one(ids, pa.concat_arrays(texts), sequence)

    return rows.mapInArrow(run, PIECE)
