"""Substring dedup by level-wise doubling: windows that repeat at one length alone are extended to twice that length.

Levels. For a target of W words the first level has windows of ceil(W / 2) words, the next twice as many, and so on;
the length is cut at W, where the result is read off, and goes on beyond it up to max_length if that is larger, until
no candidates survive. At the first level it is enough to look at some windows: every W consecutive words contain
the one with the smallest hash among their first-level windows, equal W-windows contain it at the same place, and so a
W-window can repeat only if this one does. That leaves a tenth of all windows and loses nothing. At each later
level a window is a candidate only if the windows that make it up repeated.

Exchange. A batch of rows sends its distinct hashes, as packed bytes, to hash buckets; a bucket tells each batch which
of its hashes occur elsewhere, as bits. A hash sends one entry per batch, so a passage that a third of all documents
share is no larger than any other. Batches read their texts again with the answers; texts are never sent around with
windows. Hashes are 64 bits at the first level, where an error costs only work, and 128 bits after it: words of up to 15
bytes are told apart without fail, longer ones by 128-bit xxh3, and windows by two independent chains of 64-bit mixing.
Of n different windows any two look the same with a probability of about n * n / 2 ** 129 (10 ** 14 windows: 10 ** -11).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import keyed, row_bytes, stage, window_hashes, word_halves, word_starts

KEYS = "level int, batch bigint, bucket bigint, n bigint, keys binary, again binary"
FLAGS = "level int, batch bigint, bucket bigint, flags binary"
_keys = pa.schema([("level", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("again", pa.binary())])
_flags = pa.schema([("level", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary())])


def lengths(window: int, max_length: int) -> list[int]:
    """Window lengths by level."""
    out = [max(1, (window + 1) // 2)]
    while out[-1] < max(window, max_length):
        n = out[-1] * 2
        out.append(window if out[-1] < window else n)
    return out


def running(x: np.ndarray, k: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each k consecutive values."""
    width = 1
    while width * 2 <= k:
        x = f(x[: len(x) - width], x[width:])
        width *= 2
    return f(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


class Batch:
    """The words of some texts, and what the levels so far say of their windows."""

    def __init__(self, texts: pa.Array, window: int, sizes: list[int]):
        self.window, self.sizes = window, sizes
        self.data, self.offsets = row_bytes(texts)
        self.starts, self.ends, self.rows = word_starts(self.data, self.offsets)
        self.left = np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(len(self.starts))  # words from here to the row's end
        self.hashes: dict[int, np.ndarray] = {}

    def hashed(self, k: int, which: int) -> np.ndarray:
        if not self.hashes:
            self.hashes = dict(enumerate(word_halves(self.data, self.starts, self.ends)))
        return window_hashes(self.hashes[which], k, which)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of target windows, the smallest first-level hash in each, and those hashes where they stand."""
        k, n = self.sizes[0], self.window - self.sizes[0] + 1
        h = self.hashed(k, 0)
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        least = running(h, n, np.minimum)
        whole = self.left[: len(least)] >= self.window
        least[~whole] = 0
        pad = np.zeros(n - 1, np.uint64)
        anchors = h[h == running(np.concatenate([pad, least, pad]), n, np.maximum)]
        at = np.flatnonzero(whole)
        return at, least[at], anchors

    def keys(self, level: int, at: np.ndarray) -> np.ndarray:
        """The hashes of the level's windows that start at at, as rows (high, low)."""
        k = self.sizes[level]
        return np.stack([self.hashed(k, 0)[at], self.hashed(k, 1)[at]], 1)

    def survivors(self, flags: dict[int, dict[int, bytes]], buckets: int, level: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Starts of the level's candidates, and their keys; flags: of all levels before."""
        at, least, anchors = self.first()
        if level == 0:
            return at, np.stack([anchors, np.zeros(len(anchors), np.uint64)], 1)
        order = Order(np.stack([anchors, np.zeros(len(anchors), np.uint64)], 1), buckets)
        alive = np.sort(order.keys[order.read(flags.get(0, {}))][:, 0])
        if not len(alive):
            return at[:0], np.zeros((0, 2), np.uint64)
        place = np.minimum(np.searchsorted(alive, least), len(alive) - 1)
        at = at[alive[place] == least]
        for k in range(1, level):
            keys = self.keys(k, at)
            order = Order(keys, buckets)
            at = at[order.read(flags.get(k, {}))[order.inverse]]
            if k + 1 < len(self.sizes):
                step = self.sizes[k + 1] - self.sizes[k]
                ok = np.isin(at + step, at, assume_unique=True) & (self.left[at] >= self.sizes[k + 1])
                at = at[ok]
        return at, self.keys(level, at) if level < len(self.sizes) else None


class Order:
    """The distinct keys of a batch, sorted by bucket; both sides of the exchange can make the same order."""

    def __init__(self, keys: np.ndarray, buckets: int):
        bucket = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys[:, 1], keys[:, 0], bucket))
        k, b = keys[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(1)
        group = np.cumsum(new) - 1
        self.inverse = np.empty(len(k), np.int64)
        self.inverse[order] = group
        self.keys, self.bucket = k[new], b[new]
        self.again = np.bincount(group, minlength=len(self.keys)) > 1
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(self.keys) else np.zeros(0, np.int64)

    def spans(self) -> Iterator[tuple[int, int, int]]:
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield int(self.bucket[a]), int(a), int(b)

    def messages(self, level: int, batch: int) -> list[dict]:
        out = []
        for bucket, a, b in self.spans():
            low = self.keys[a:b, 1].astype("<u8").tobytes() if level else b""
            out.append({"level": level, "batch": batch, "bucket": bucket, "n": b - a, "keys": self.keys[a:b, 0].astype("<u8").tobytes() + low, "again": np.packbits(self.again[a:b]).tobytes()})
        return out

    def read(self, flags: dict[int, bytes]) -> np.ndarray:
        """Whether each distinct key repeats."""
        out = np.zeros(len(self.keys), bool)
        for bucket, a, b in self.spans():
            out[a:b] = np.unpackbits(np.frombuffer(flags[bucket], np.uint8), count=b - a).astype(bool)
        return out


def answer(table: pa.Table) -> pa.Table:
    """For one bucket of one level: which keys of each message occur twice or more in all messages."""
    rows = table.to_pylist()
    high = [np.frombuffer(r["keys"], "<u8", r["n"]) for r in rows]
    low = [np.frombuffer(r["keys"], "<u8", r["n"], 8 * r["n"]) if r["level"] else np.zeros(r["n"], "<u8") for r in rows]
    again = [np.unpackbits(np.frombuffer(r["again"], np.uint8), count=r["n"]).astype(bool) for r in rows]
    h, w, twice = np.concatenate(high), np.concatenate(low), np.concatenate(again)
    order = np.lexsort((w, h))
    hs, ws = h[order], w[order]
    same = (hs[1:] == hs[:-1]) & (ws[1:] == ws[:-1])
    flag = twice[order]
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(h), bool)
    out[order] = flag
    parts = np.split(out, np.cumsum([r["n"] for r in rows])[:-1])
    return pa.Table.from_pylist([{"level": r["level"], "batch": r["batch"], "bucket": r["bucket"], "flags": np.packbits(x).tobytes()} for r, x in zip(rows, parts, strict=True)], schema=_flags)


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """The texts of each batch of rows, from Arrow batches that may end anywhere; a batch's rows come together."""
    held, current = [], None
    for b in batches:
        ids = b.column("batch").to_numpy()
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1, append=ids[-1] + 1)) if len(ids) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if held and ids[x] != current:
                yield current, pa.concat_arrays(held)
                held = []
            current = int(ids[x])
            held.append(b.column("text").slice(x, y - x).cast(pa.large_string()))
    if held:
        yield current, pa.concat_arrays(held)


def flags_of(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for r in table.to_pylist():
        out.setdefault(r["level"], {})[r["bucket"]] = r["flags"]
    return out


def covered(at: np.ndarray, window: int, n: int) -> np.ndarray:
    """Words in any of the windows that start at at."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, max_length: int = 0, batch_rows_log2: int = 8, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_words, n_removed, kept_text, spans (first and end word of each removed stretch), longest.

    A word goes if it is in a window of `window` consecutive words of its text whose word sequence also starts
    anywhere else, in the same text or another; all windows are judged on the input. kept_text: the words that stay,
    joined by one space. Null and empty texts have no words; a text shorter than the window loses nothing; equal
    rows repeat each other. Other columns are not read. longest: the largest level at which a window of the text still
    repeats (0: none); levels beyond the window are looked at only if max_length says so, as they can't change what
    goes. batch_rows_log2: rows of a batch; bucket_bytes: bytes of text for which there is one bucket.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).selectExpr("rid", f"shiftright(rid, {batch_rows_log2}) batch", "cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    sizes = lengths(window, max_length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_batch(batches):
            _, keys = Batch(texts, window, sizes).survivors({}, buckets, 0)
            if out := Order(keys, buckets).messages(0, batch):
                yield pa.RecordBatch.from_pylist(out, schema=_keys)

    def extend(level: int):
        def f(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _keys.empty_table()
            left = left.sort_by("rid")
            _, keys = Batch(left["text"].combine_chunks(), window, sizes).survivors(flags_of(right), buckets, level)
            return pa.Table.from_pylist(Order(keys, buckets).messages(level, left["batch"][0].as_py()), schema=_keys)

        return f

    answered = stage(rows.select("batch", "text").mapInArrow(scan, KEYS).groupBy("bucket").applyInArrow(answer, FLAGS), "flags0")
    for level in range(1, len(sizes)):
        found = rows.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(extend(level), KEYS)
        more = stage(found.groupBy("bucket").applyInArrow(answer, FLAGS), f"flags{level}")
        if sizes[level] > window and more.isEmpty():
            sizes = sizes[:level]
            break
        answered = answered.unionByName(more)

    result = "rid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<first:bigint,end:bigint>>, longest int"
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("longest", pa.int32())])
    target = sizes.index(window)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        left = left.sort_by("rid")
        texts = left["text"].combine_chunks()
        batch, flags = Batch(texts, window, sizes), flags_of(right)
        n = len(batch.starts)
        repeats = np.zeros(0, np.int64)
        longest = np.zeros(left.num_rows, np.int32)
        for level in range(target, len(sizes)) if right.num_rows else ():
            at, keys = batch.survivors(flags, buckets, level)
            if not len(at):
                break
            order = Order(keys, buckets)
            at = at[order.read(flags.get(level, {}))[order.inverse]]
            repeats = at if level == target else repeats
            longest[np.searchsorted(batch.rows, at, "right") - 1] = sizes[level]
        gone = covered(repeats, window, n)
        out = []
        for i, text in enumerate(texts.to_pylist()):
            a, b = batch.rows[i], batch.rows[i + 1]
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
            raw, base = text.encode("utf-8", "surrogatepass"), batch.offsets[i]
            words = [raw[s:e] for s, e in zip((batch.starts[a:b][~mine] - base).tolist(), (batch.ends[a:b][~mine] - base).tolist(), strict=True)]
            out.append({"n_words": int(b - a), "n_removed": int(mine.sum()), "kept_text": b" ".join(words).decode("utf-8", "surrogatepass"), "spans": [{"first": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)], "longest": int(longest[i])})
        for r, rid, d in zip(out, left["rid"].to_pylist(), left["doc_id"].to_pylist(), strict=True):
            r |= {"rid": rid, "doc_id": d}
        return pa.Table.from_pylist(out, schema=schema)

    return rows.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(finish, result)
