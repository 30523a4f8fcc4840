"""MinHash near-dedup with ProbMinHash signatures of weighted word shingles.

ProbMinHash. Every shingle of a text is a Poisson process whose rate is its weight, 1 + ln of how often it stands there;
its arrivals come at times that a hash of the shingle alone decides and fall into one of m registers each, and a
register keeps the shingle that arrived first. A process ends as soon as its next arrival is later than all registers' first
ones, so a text costs about n + m ln m steps. Two texts agree in a register with the probability Jaccard similarity of their weights.

Links. Two texts are linked if the probability Jaccard similarity of their weighted shingles, or the plain Jaccard
similarity of their shingle sets, is threshold or more; both are verified on whole sets. Without repeated shingles the two
are the same. A text with some gets a second signature, of its set, so each similarity has candidates of its own.

Search. Texts with the same words in the same order are one node from the start. Bands of registers give buckets;
buckets with the same members count once. In buckets beyond `block` members leaders collapse large groups in linear
work. Then members of a bucket are compared in blocks of bounded size, in two steps: whole signatures leave the pairs
within six standard errors of the threshold, each in the first band it shares only, and these meet their sets in
tiles of bounded size, where a spanning forest of the verified links is kept. So no step puts out more rows than members went in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import drop_staged, gather, keyed, mix, release, row_bytes, stage, window_hashes, with_key, word_hashes, word_starts
from quillet.llm.components import components, dealt_blocks, distinct_buckets, leaders, open_members

_space = re.compile(rb"[\x20\x09-\x0D]+")
_GOLD = 0x9E3779B97F4A7C15


def shingles(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, hash and count of each distinct shingle of k words, by row and hash; a text of fewer words is one shingle."""
    data, offsets = row_bytes(texts)
    starts, ends, rows = word_starts(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(rows)
    left = np.repeat(rows[1:], n) - np.arange(len(words))
    grams = window_hashes(words, k)
    at = np.flatnonzero(left[: len(grams)] >= k)
    row, h = [np.searchsorted(rows, at, "right") - 1], [grams[at]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            x = mix(np.full(len(short), size, np.uint64))
            for j in range(size):
                x = mix(x * np.uint64(_GOLD) + words[rows[short] + j])
            row.append(short)
            h.append(x)
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows x m) of weighted elements: in each register the element whose first arrival there is earliest.

    All processes advance by one arrival at a time; a process ends when it is later than every register of its row.
    A row without elements has zeros.
    """
    time = np.full(n_rows * m, np.inf)
    sig = np.zeros(n_rows * m, np.uint64)
    base, rate, x = row * m, 1.0 / weight, np.zeros(len(row))
    turn, e = 0, element
    while len(e):
        turn += 1
        h = mix(e + np.uint64(turn * _GOLD & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * rate
        slot = base + (mix(h) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(x < time[slot])
        early = early[np.argsort(-x[early], kind="stable")]  # the earliest is written last and stays
        time[slot[early]] = x[early]
        sig[slot[early]] = e[early]
        last = time.reshape(n_rows, m).max(1)
        alive = np.flatnonzero(x < last[base // m])
        e, base, rate, x = e[alive], base[alive], rate[alive], x[alive]
    return sig.reshape(n_rows, m)


def weights(count: np.ndarray) -> np.ndarray:
    """What a shingle weighs that a text has so often; 1 for once."""
    return 1 + np.log(count)


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard similarity of two vectors of weights: the sum over i of 1 / sum_j max(x_j / x_i, y_j / y_i).

    Elements are sorted by y / x: for element i, those up to it have their maximum in x, those after it in y.
    """
    with np.errstate(divide="ignore"):
        order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature; the band's number is in it."""
    out = mix(np.arange(bands, dtype=np.uint64) + np.uint64(_GOLD))[None, :].repeat(len(sig), 0)
    for j in range(rows):
        out = mix(out * np.uint64(_GOLD) + sig[:, j : bands * rows : rows].astype(np.uint64))
    return out


def signatures(rows: DataFrame, k: int, bands: int, band_rows: int) -> DataFrame:
    """rid, doc_id, digest (of the word sequence), n (distinct shingles), bands (a key for each band of the weighted
    shingles' signature, then of the set's, null where it is the same; none without words), sig (of the set, 16 bits a
    register) and wsig (of the weighted shingles; null if the same)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = bands * band_rows
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                texts, size = batch.column("text"), min(1024, whole.num_rows - a)
                row, h, count = shingles(texts, k)
                n = np.bincount(row, minlength=size)
                plain = mix(prob_minhash(row, h, np.ones(len(h)), size, m)).astype("<u2")
                heavy = np.zeros(size, bool)
                heavy[row[count > 1]] = True
                at = np.flatnonzero(heavy[row])
                place = np.cumsum(heavy) - 1
                weighted = mix(prob_minhash(place[row[at]], h[at], weights(count[at]), int(heavy.sum()), m)).astype("<u2")
                keys, more = band_keys(plain, bands, band_rows), band_keys(weighted, bands, band_rows)
                listed = []
                for i in range(size):
                    if not n[i]:
                        listed.append([])
                    elif not heavy[i]:
                        listed.append(keys[i].view(np.int64).tolist())
                    else:
                        w, s = more[place[i]].view(np.int64).tolist(), keys[i].view(np.int64).tolist()
                        listed.append(w + [None if x == y else y for x, y in zip(w, s, strict=True)])
                digest = [hashlib.blake2b(_space.sub(b" ", t.encode("utf-8", "surrogatepass")).strip(b" "), digest_size=16).digest() for t in texts.to_pylist()]
                wsig = [weighted[place[i]].tobytes() if heavy[i] else None for i in range(size)]
                yield pa.RecordBatch.from_pydict(
                    {"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "digest": pa.array(digest, pa.binary()), "n": n.astype(np.int64), "bands": pa.array(listed, pa.list_(pa.int64())), "sig": pa.array([x.tobytes() for x in plain], pa.binary()), "wsig": pa.array(wsig, pa.binary())}
                )

    return rows.mapInArrow(sign, "rid bigint, doc_id bigint, digest binary, n bigint, bands array<bigint>, sig binary, wsig binary")


def bucket_members(signed: DataFrame, reps: DataFrame, bands: int) -> DataFrame:
    """key, id, n, band of the members of buckets of two or more."""
    of = signed.select("rid", "n", "bands").join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi")
    keys = of.select(F.posexplode("bands").alias("pos", "key"), F.col("rid").alias("id"), "n").where("key is not null")
    keys = keys.select("key", "id", "n", (F.col("pos") % bands).alias("band"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return keys.join(shared.hint("merge"), "key")


class Tile:
    """Some members of buckets with their signatures, and the pairs of them that are worth verifying."""

    def __init__(self, table: pa.Table, bands: int):
        get = lambda c: table[c].to_numpy()
        self.ids, self.n, self.comp, self.band, self.key, self.part = (get(c) for c in ("id", "n", "comp", "band", "key", "part"))
        sig = table["sig"].to_pylist()
        second = [x or y for x, y in zip(table["wsig"].to_pylist(), sig, strict=True)]
        self.sig = np.frombuffer(b"".join(sig), "<u2").reshape(len(sig), -1)
        self.weighted = np.frombuffer(b"".join(second), "<u2").reshape(len(sig), -1) if table["wsig"].null_count < len(sig) else None
        self.bands, self.whole = bands, table["low"][0] == table["high"][0]

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of members to compare, all of one with all of the other: a bucket with itself, or two parts of one."""
        order = np.lexsort((self.ids, self.part, self.key))
        cuts = np.flatnonzero(np.diff(self.key[order], prepend=self.key[order[0]] - 1, append=self.key[order[-1]] + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[a:b]
            part = self.part[mine]
            if self.whole:
                yield mine, mine
            elif part[0] != part[-1]:
                yield mine[part == part[0]], mine[part != part[0]]

    def pairs(self, least: float, ratio: float, step: int = 16_384) -> np.ndarray:
        """Rows (i, j, registers that agree) of the pairs at least of whose registers agree, in the first band they share."""
        held, size, out = [], 0, []
        for x, y in self.spans():
            for a in range(0, len(x), max(1, step // len(y))):
                rows = np.arange(a, min(len(x), a + max(1, step // len(y))))
                i, j = np.repeat(x[rows], len(y)), np.tile(y, len(rows))
                if x is y:
                    upper = np.repeat(rows, len(y)) < np.tile(np.arange(len(y)), len(rows))
                    i, j = i[upper], j[upper]
                ok = (self.comp[i] != self.comp[j]) & (np.minimum(self.n[i], self.n[j]) >= ratio * np.maximum(self.n[i], self.n[j]))
                if ok.any():
                    held.append((i[ok], j[ok]))
                    size += int(ok.sum())
                if size >= step:
                    out.append(self.screened(held, least))
                    held, size = [], 0
        if held:
            out.append(self.screened(held, least))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def screened(self, held: list, least: float) -> np.ndarray:
        i, j = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        m = self.sig.shape[1]
        same = (self.sig[i] == self.sig[j]).sum(1)
        if self.weighted is not None:
            same = np.maximum(same, (self.weighted[i] == self.weighted[j]).sum(1))
        ok = same >= least * m
        i, j, same = i[ok], j[ok], same[ok]
        shared = np.zeros((len(i), self.bands), bool)
        kinds = [self.sig] if self.weighted is None else [self.sig, self.weighted]
        for u in kinds:
            for v in kinds:
                shared |= (u[i] == v[j]).reshape(len(i), self.bands, m // self.bands).all(2)
        first = shared.argmax(1) == self.band[i]
        return np.stack([i[first], j[first], same[first]], 1)


def tiles(pairs: np.ndarray, n: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The pairs in groups whose members' sets have about 2 x most elements together, or are one pair."""
    used = np.unique(pairs[:, :2])
    place = np.zeros(len(n), np.int64)
    place[used] = np.cumsum(n[used]) // most
    key = place[pairs[:, 0]] * (place.max() + 1) + place[pairs[:, 1]]
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield pairs[order[a:b]]


PAIRS = "tile string, ids array<bigint>, pairs binary"
_pairs = pa.schema([("tile", pa.string()), ("ids", pa.list_(pa.int64())), ("pairs", pa.binary())])


def candidates(rows: DataFrame, signed: DataFrame, bands: int, least: float, ratio: float, block: int, most: int = 1 << 20) -> DataFrame:
    """tile, ids, pairs: tiles of candidate pairs, as places in ids, from members (key, id, n, band, c, comp) of open buckets."""
    groups = 1 + rows.count() // 4096
    dealt = dealt_blocks(rows, block).join(signed.select(F.col("rid").alias("id"), "sig", "wsig"), "id")
    dealt = dealt.withColumn("task", F.when(F.col("part") < 0, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")))

    def screen(table: pa.Table) -> pa.Table:
        tile, out = Tile(table, bands), []
        name = ":".join(str(table[c][0].as_py()) for c in ("task", "low", "high"))
        pairs = tile.pairs(least, ratio)
        for k, mine in enumerate(tiles(pairs, tile.n, most)) if len(pairs) else ():
            used, at = np.unique(tile.ids[mine[:, :2]], return_inverse=True)
            body = np.column_stack([at.reshape(-1, 2), mine[:, 2]]).astype("<u4")
            out.append({"tile": f"{name}:{k}", "ids": used.tolist(), "pairs": body.tobytes()})
        return pa.Table.from_pylist(out, schema=_pairs)

    return dealt.groupBy("task", "low", "high").applyInArrow(screen, PAIRS)


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """id, grams, counts: each text's distinct shingles, and how often it has each; counts is null if all stand once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                row, h, count = shingles(batch.column("text"), k)
                ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(h.view(np.int64)))
                heavy = np.zeros(batch.num_rows, bool)
                heavy[row[count > 1]] = True
                counts = [c if x else None for c, x in zip(np.split(count, ends[:-1]), heavy, strict=True)] if batch.num_rows else []
                yield pa.RecordBatch.from_pydict({"id": batch.column("rid"), "grams": grams, "counts": pa.array(counts, pa.list_(pa.int64()))})

    return rows.select("rid", "text").mapInArrow(sets, "id bigint, grams array<bigint>, counts array<bigint>")


class Sets:
    """Shingle sets of some texts, the shingles numbered from 0."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray | None]):
        self.size = np.array([len(x) for x in grams], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.unique(np.concatenate(grams), return_inverse=True)[1] if len(grams) else np.zeros(0, np.int64)
        self.has = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 0, bool)
        self.counts = counts

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i] + self.size[i]]

    def linked(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the sets of each pair are similar enough; pairs of one i stand together."""
        common = np.zeros(len(i), np.int64)
        cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine, others = self.of(i[a]), j[a:b]
            self.has[mine] = True
            size = self.size[others]
            common[a:b] = np.add.reduceat(self.has[gather(self.flat, self.at[others], size)].astype(np.int64), np.cumsum(size) - size)
            self.has[mine] = False
        ok = common >= threshold * (self.size[i] + self.size[j] - common) - 1e-9
        for k in np.flatnonzero(~ok):
            if self.counts[i[k]] is not None or self.counts[j[k]] is not None:
                ok[k] = self.probability(i[k], j[k]) >= threshold - 1e-9
        return ok

    def probability(self, i: int, j: int) -> float:
        element, place = np.unique(np.concatenate([self.of(i), self.of(j)]), return_inverse=True)
        w = np.zeros((2, len(element)))
        for side, k, at in ((0, i, place[: self.size[i]]), (1, j, place[self.size[i] :])):
            w[side, at] = 1 if self.counts[k] is None else weights(self.counts[k])
        return probability_jaccard(w[0], w[1])


def forest(pairs: np.ndarray, sets: Sets, threshold: float, step: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest of the links among pairs (i, j, registers that agree); pairs in one tree already aren't verified."""
    root, out = np.arange(len(sets.size)), []
    pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]  # likely links first
    for a in range(0, len(pairs), step):
        i, j = pairs[a : a + step, 0], pairs[a : a + step, 1]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        if not len(i):
            continue
        ok = sets.linked(i, j, threshold)
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def verified(tiled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: the links of staged tiles, a spanning forest of each."""
    members = tiled.select("tile", F.explode("ids").alias("id")).join(sets, "id")

    def check(members: pa.Table, tile: pa.Table) -> pa.Table:
        members = members.sort_by("id")
        ids = members["id"].to_numpy()
        grams = [np.asarray(x, np.int64) for x in members["grams"].combine_chunks().to_numpy(zero_copy_only=False)]
        counts = [None if x is None else np.asarray(x, np.int64) for x in members["counts"].combine_chunks().to_numpy(zero_copy_only=False)]
        pairs = np.frombuffer(tile["pairs"][0].as_py(), "<u4").reshape(-1, 3).astype(np.int64)
        links = forest(pairs, Sets(grams, counts), threshold)
        return pa.Table.from_pydict({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return members.groupBy("tile").cogroup(tiled.select(F.col("tile").alias("of"), "pairs").groupBy("of")).applyInArrow(check, "a bigint, b bigint")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, for leaders."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x"), F.col("counts").alias("cx")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y"), F.col("counts").alias("cy")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "cx", "cy")]
            ok = [bool(Sets([x, y], [cx, cy]).linked(np.array([0]), np.array([1]), threshold)[0]) for x, y, cx, cy in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, bands: int = 36, band_rows: int = 7, block: int = 1024) -> DataFrame:
    """One row per row of docs: rid, doc_id, class_id, class_size, kept.

    Classes are the components of links; texts link when their words are the same, or when the Jaccard similarity of
    their k-word shingles, plain or weighted, is threshold or more and a band of their signatures agrees (36 bands of 7
    registers: 99.98 % of pairs at 0.8, more above). class_id: the smallest doc_id of the class (null if all are
    null); the row that has it is kept (the first in scan order if several have; a row with a null doc_id only if
    all have). Null and empty texts have no words and are one class; a text of fewer than k words is one shingle.
    Equal rows are copies. Other columns are not read. An empty table gives no rows. block: how many members are compared
    with each other in one task.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col).selectExpr("rid", "cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    signed = stage(signatures(rows, k, bands, band_rows), "signatures")
    reps = signed.groupBy("digest").agg(F.min("rid").alias("rep"))
    found = stage(bucket_members(signed, reps, bands), "buckets")
    members = stage(distinct_buckets(found), "members")
    drop_staged(found)
    large, comps = members.where(F.col("c") > block), None
    if not large.isEmpty():
        sets = stage(shingle_sets(rows.join(large.select(F.col("id").alias("rid")).distinct(), "rid", "left_semi"), k), "shingles")
        comps = leaders(large.withColumn("weight", F.lit(0)), lambda pairs: similar(pairs, sets, threshold), threshold)
    margin = 6 * (threshold * (1 - threshold) / (bands * band_rows)) ** 0.5
    tiled = stage(candidates(open_members(members, comps), signed, bands, threshold - margin, threshold, block), "tiles")
    sets = stage(shingle_sets(rows.join(tiled.select(F.explode("ids").alias("rid")).distinct(), "rid", "left_semi"), k), "shingles")
    edges = stage(verified(tiled, sets, threshold), "links")
    comps = components(edges if comps is None else edges.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
    node = signed.select("rid", "doc_id", "digest").join(reps.hint("merge"), "digest")
    node = node.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("rid", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    node = stage(node, "nodes")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    best = node.groupBy("comp").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    return node.join(best.hint("merge"), "comp").select("rid", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class, with all columns of docs; docs must be a table or staged."""
    marked, key = with_key(docs)
    kept = classes(docs, id_col, text_col, **how).where("kept").select(F.col("rid").alias(key))
    return marked.join(kept, key, "left_semi").drop(key)
