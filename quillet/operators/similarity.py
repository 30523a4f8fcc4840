"""Nearest neighbours and similarity joins of vectors.

One query vector against a table is a Catalyst expression with a top-k. Many against many are blocks of cells (see
cells.py): vectors are packed into matrices of `block` rows, blocks into tiles, and the blocks of a pair of tiles are multiplied
in one task, which holds two tiles and one product whatever the tables' sizes. Pairs that can't matter by their bounds are
left out; results are exact. Tables of few blocks are multiplied in one task. For approximate search see vector_index.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.vectors import dot
from quillet.operators import cells
from quillet.sources.held import held

FOUND = "a bigint, b bigint, sim double"
DECIMALS = 6  # ranks are by similarity rounded to this, so the order of summation can't turn ties around
#: Columns of a product whose largest number is looked at first, and so many rows of it are made at once.
GROUPED, ROWS_AT_ONCE = 16, 256


def scored(corpus: DataFrame, vector: list[float] | DataFrame, *keep: str) -> DataFrame:
    """id, sim and the columns to keep; vector: the numbers, or one row with the column q, which is broadcast in the same job."""
    if isinstance(vector, DataFrame):
        return corpus.crossJoin(F.broadcast(vector.select("q"))).select("id", dot("embedding", "q").alias("sim"), *keep)
    return corpus.select("id", dot("embedding", F.array(*[F.lit(float(x)) for x in vector])).alias("sim"), *keep)


def topk(corpus: DataFrame, vector: list[float] | DataFrame, k: int = 5, threshold: float = 0.3, where: Column | None = None) -> DataFrame:
    """id, similarity (4 decimals) of the k rows closest to a unit vector, at threshold or more; ties by id."""
    rows = scored(corpus if where is None else corpus.where(where), vector)
    rows = rows.orderBy(F.desc(F.round("sim", DECIMALS)), "id").limit(k)
    return rows.where(F.col("sim") >= threshold).select("id", F.round("sim", 4).alias("similarity"))


def together(block: int, *sides: DataFrame) -> DataFrame | None:
    """All rows of small tables in one task as (side, id, embedding); None if a table has more than a few blocks."""
    if any(v.count() > cells.FEW_BLOCKS * block for v in sides):
        return None
    both = sides[0].select(F.lit(0).alias("side"), "id", "embedding")
    for k, v in enumerate(sides[1:], 1):
        both = both.unionByName(v.select(F.lit(k).alias("side"), "id", "embedding"))
    return both.where("embedding is not null").repartition(1)


def in_one_task(rows: DataFrame, block: int, work, alone: bool) -> DataFrame:
    """work on blocks of the first side and of the last one (the same, if alone: of each two once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("side").to_numpy(), b.column("id").to_numpy(), cells.matrix_of(b.column("embedding"))) for b in batches if b.num_rows]
        if not found:
            return
        if len({m.shape[1] for _, _, m in found}) > 1:
            raise ValueError(f"vectors have {sorted({m.shape[1] for _, _, m in found})} numbers; all must have as many")
        side, ids, m = (np.concatenate(x) for x in zip(*found, strict=True))
        left, right = side == 0, side == (0 if alone else 1)
        x, xi, y, yi = m[left], ids[left], m[right], ids[right]
        for i in range(0, len(x), block):
            for j in range(i if alone else 0, len(y), block):
                a, b, sim = work(xi[i : i + block], x[i : i + block], yi[j : j + block], y[j : j + block], alone and i == j)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return rows.mapInArrow(run, FOUND)


def kept(vectors: DataFrame) -> DataFrame:
    """id, embedding, written once: counted, sampled and packed from there."""
    return held(vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding"), "vectors")


def centres_of(vectors: DataFrame, block: int) -> np.ndarray | None:
    """Centres of the cells of a kept table, or None for a table of few blocks."""
    n = vectors.count()
    k = cells.cells_for(n, block)
    return cells.learn_centres(cells.sample_of(vectors, n), k) if k > 1 else None


def top_of(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the k pairs with the largest sim; ties by b."""
    order = np.lexsort((b, -np.round(sim, DECIMALS), a))
    first = np.flatnonzero(np.diff(a[order], prepend=a[order][:1] - 1))
    keep = order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < k]
    return a[keep], b[keep], sim[keep]


def hopeful(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, n: int, before: bool, least: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Places in q and c of what may be among the n closest of each query and least or more; None if floats can't tell or hardly less than all may be.

    Rows are multiplied as floats. The n-th largest of the maxima of groups of columns is no more than the n-th largest
    product, so what is below it by more than twice the error of a sum and of the rounding can't count.
    """
    groups = len(ci) // GROUPED
    if q.dtype != np.float32 or c.dtype != np.float32 or groups < 2 * n:
        return None
    error = float_error(q, c) + 2 * 10.0**-DECIMALS
    if not np.isfinite(error):
        return None
    own = ci.max() >= qi.min() if before else not apart and len(np.intersect1d(qi, ci)) > 0
    at = []
    for i in range(0, len(q), ROWS_AT_ONCE):
        ids, sim = qi[i : i + ROWS_AT_ONCE, None], q[i : i + ROWS_AT_ONCE] @ c.T
        if own:
            sim[(ids <= ci) if before else (ids == ci)] = -np.inf
        top = sim[:, : groups * GROUPED].reshape(len(sim), GROUPED, groups).max(1)
        edge = np.partition(top, groups - n, 1)[:, groups - n].astype(np.float64)
        limit = np.maximum(np.maximum(edge, least[i : i + ROWS_AT_ONCE]) - error, float(np.finfo(np.float32).min) / 2)
        near = np.flatnonzero(sim >= np.nextafter(limit.astype(np.float32), np.float32(-np.inf))[:, None])
        if len(near) > sim.size // GROUPED + n * len(sim):
            return None
        at.append((near // len(ci) + i, near % len(ci)))
    return tuple(np.concatenate(x) for x in zip(*at, strict=True))


def best_of(k: int, before: bool = False, threshold: float = -np.inf, apart: bool = False):
    """Of each query of a block the k closest rows of another block, itself left out; ties by id, as the ranking of all blocks has them.

    before: only rows with smaller ids count. threshold: what a row must have at least. apart: equal ids are of different
    rows. best.merge: the same of several results; best.reached: what a row must have at least by these.
    """
    itself = (lambda q, c: q <= c) if before else (lambda q, c: np.zeros(np.broadcast(q, c).shape, bool)) if apart else (lambda q, c: q == c)

    def best(qi, q, ci, c, _, least=None):
        if not len(qi) or not len(ci) or (before and ci.min() >= qi.max()):
            return qi[:0], ci[:0], np.zeros(0)
        n = min(k, len(ci))
        low = np.full(len(qi), threshold) if least is None else np.maximum(threshold, np.round(least, DECIMALS) - 2 * 10.0**-DECIMALS)
        some = hopeful(qi, q, ci, c, n, before, low, apart)
        if some is not None:
            a, b = some
            sim = exact(q, c, a, b)
            keep = np.isfinite(sim) & (sim >= threshold) & ((np.round(sim, DECIMALS) >= low[a]) | (least is None)) & ~itself(qi[a], ci[b])
            return top_of(qi[a[keep]], ci[b[keep]], sim[keep], n)
        q, c = q.astype(np.float64, copy=False), c.astype(np.float64, copy=False)
        sim = q @ c.T
        sim[itself(qi[:, None], ci[None, :])] = -np.inf
        sim[sim < threshold] = -np.inf
        key = np.round(sim, DECIMALS)
        edge = np.partition(key, sim.shape[1] - n, 1)[:, sim.shape[1] - n]
        if least is not None:
            edge = np.maximum(edge, np.round(least, DECIMALS) - 2 * 10.0**-DECIMALS)
        near = (key >= edge[:, None]) & np.isfinite(sim)
        for r in np.flatnonzero(near.sum(1) > n):  # equal rows may be many
            tied = np.flatnonzero(near[r])
            near[r, tied[np.lexsort((ci[tied], -key[r, tied]))[n:]]] = False
        a, b = np.nonzero(near)
        return qi[a], ci[b], sim[a, b]

    def reached(qi, found, least):
        a, _, sim = found  # of best.merge, so in the order of a
        first = np.flatnonzero(np.diff(a, prepend=a[:1] - 1))
        full = first[np.diff(first, append=len(a)) >= k]
        order = np.argsort(qi)
        at, least = order[np.searchsorted(qi, a[full], sorter=order)], least.copy()
        least[at] = np.maximum(least[at], sim[full + k - 1])
        return least

    best.merge, best.reached = lambda a, b, sim: top_of(a, b, sim, k), reached
    return best


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.0, block: int = 2048, first: int = 4) -> DataFrame:
    """query_id, id, rank (from 0), sim: for each query the k closest rows of the corpus, itself left out; ties by id. Exact.

    Each block of queries meets the `first` most promising blocks of the corpus. The worst k-th best similarity that its
    queries have then is what any other block must be able to reach, by its bound, to be looked at.
    """
    q, c, best = kept(queries), kept(corpus), best_of(k)
    small = together(block, q, c)
    if small is not None:
        return ranked(in_one_task(small, block, best, False), k, threshold)
    centres = centres_of(c, block)
    qb, cb = cells.blocks(q, block, centres), cells.blocks(c, block, centres)
    qm, cm = cells.bounds(qb), cells.bounds(cb)
    schema = pa.schema([("block", pa.int64()), ("block2", pa.int64()), ("bound", pa.float64())])

    def promising(row: pa.RecordBatch) -> pa.RecordBatch:
        """For each block of queries its `first` best blocks in this group of bounds."""
        (i, *a), (j, *b) = cells.of_bounds(row, ""), cells.of_bounds(row, "2")
        angle = a[0] @ b[0].T
        n = min(first, len(j))
        at = np.argpartition(-angle, n - 1, 1)[:, :n]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(i, n), pa.int64()), pa.array(j[at].ravel(), pa.int64()), pa.array(np.take_along_axis(angle, at, 1).ravel())], schema=schema)

    near = cells.chosen_pairs(qm, cm, promising, "block bigint, block2 bigint, bound double")
    w = Window.partitionBy("block").orderBy(F.desc("bound"), "block2")
    near = held(near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).select("block", "block2"), "near")
    across = cm.count()
    tiles = qm.count() * across
    found = held(ranked(cells.multiplied(cells.meeting(near, qm, cm), qb, cb, best, FOUND, tiles, across), k, None), "first")
    # what a block's worst-off query has for its k-th best; without k rows anything helps
    ids = qb.select("block", F.explode("ids").alias("query_id"))
    kth = ids.join(found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("kth")), "query_id", "left")
    least = kth.groupBy("block").agg(F.min(F.coalesce("kth", F.lit(-float("inf")))).alias("least"))

    def reaching(row: pa.RecordBatch) -> pa.RecordBatch:
        (i, *a), (j, *b) = cells.of_bounds(row, ""), cells.of_bounds(row, "2")
        limit = np.maximum(row.column("limits")[0].values.to_numpy(), threshold)
        return cells.needs(row, i, j, (cells.most(*a, *b) + 10.0**-DECIMALS >= limit[:, None]) | (limit[:, None] <= 0), limit)

    lim = qm.select("grp", F.posexplode("blocks").alias("at", "block")).join(least.select("block", "least"), "block")
    lim = lim.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda x: x["least"]).alias("limits"))  # GROUP numbers
    # the blocks of the first round are among them, as far as they have rows that count
    rest = cells.chosen_pairs(qm.join(lim, "grp"), cm, reaching, cells.NEED)
    return ranked(cells.multiplied(rest, qb, cb, best, FOUND, tiles, across), k, threshold)


def closest(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, before: bool = False, block: int = 2048, apart: bool = False) -> DataFrame:
    """query_id, id, rank (from 0), sim: knn() of the rows at threshold or more. Exact; ties by id. before: only rows with smaller ids than the query's count.

    A query brings k rows a tile at most, whatever number of rows is close. apart: equal ids of the two tables are of
    different rows. queries may be the corpus itself, which is then packed once.
    """
    q, best = kept(queries), best_of(k, before, threshold, apart)
    c = q if queries is corpus else kept(corpus)
    small = together(block, q, c)
    if small is not None:
        return ranked(in_one_task(small, block, best, False), k, None)
    centres = None if before else centres_of(c, block)
    qb = cells.blocks(q, block, centres, before)
    cb = qb if c is q else cells.blocks(c, block, centres, before)
    qm = cells.bounds(qb)
    cm = qm if c is q else cells.bounds(cb)
    across = cm.count()
    return ranked(cells.multiplied(cells.close_tiles(qm, cm, threshold, before=before), qb, cb, best, FOUND, qm.count() * across, across), k, None)


def ranked(found: DataFrame, k: int, threshold: float | None) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", DECIMALS)), "b")
    top = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    top = top if threshold is None else top.where(F.col("sim") >= threshold)
    return top.select(F.col("a").alias("query_id"), F.col("b").alias("id"), (F.col("rn") - 1).alias("rank"), "sim")


def float_error(x: np.ndarray, y: np.ndarray) -> float:
    """Twice the error that a product of rows of floats can have; not finite if rows aren't."""
    length = [float(np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64).max(initial=0))) for m in (x, y)]
    return 2 * (x.shape[1] + 2) * float(np.finfo(np.float32).eps) * length[0] * length[1]


def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, in double precision, of the rows of x at a with those of y at b."""
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", x[a[i : i + step]].astype(np.float64), y[b[i : i + step]].astype(np.float64)) for i in range(0, len(a), step)] or [np.zeros(0)])


def reaching(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y and the inner product, in double precision, of the rows at threshold or more.

    Rows of floats are multiplied as floats first; what can reach the threshold with twice the error that a sum of so
    many products can have is computed again.
    """
    if x.dtype != np.float32 or y.dtype != np.float32:
        sim = x @ y.T
        a, b = np.nonzero(sim >= threshold)
        return a, b, sim[a, b]
    error = float_error(x, y)
    if not np.isfinite(error):
        return reaching(x.astype(np.float64), y.astype(np.float64), threshold)
    near = np.flatnonzero(x @ y.T >= np.nextafter(np.float32(threshold - error), np.float32(-np.inf)))
    a, b = near // len(y), near % len(y)
    sim = exact(x, y, a, b)
    keep = sim >= threshold
    return a[keep], b[keep], sim[keep]


def pairs(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """a, b, sim for all pairs a < b at threshold or more; exact. Pairs of blocks that can't reach it aren't multiplied."""

    def close(xi, x, yi, y, same, _=None):
        a, b, s = reaching(x, y, threshold)
        a, b = xi[a], yi[b]
        keep = a < b if same else a != b
        return np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]

    v = kept(vectors)
    small = together(block, v)
    if small is not None:
        return in_one_task(small, block, close, True)
    b = cells.blocks(v, block, centres_of(v, block))
    m = cells.bounds(b)
    n = m.count()
    return cells.multiplied(cells.close_tiles(m, m, threshold, True), b, b, close, FOUND, n * n)


def pruning(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """block_pairs, multiplied: how many pairs of blocks there are, and how many of them pairs() multiplies. One row."""
    v = kept(vectors)
    b = cells.blocks(v, block, centres_of(v, block))
    n = b.agg((F.count("*") * (F.count("*") + 1) / 2).cast("long").alias("block_pairs"))
    return n.crossJoin(cells.close_pairs(b, b, threshold, True).agg(F.count("*").alias("multiplied")))  # one row each


def cross(left: DataFrame, right: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """a (of left), b (of right), sim for all pairs at threshold or more; exact."""

    def close(xi, x, yi, y, *_):
        a, b, s = reaching(x, y, threshold)
        return xi[a], yi[b], s

    x, y = kept(left), kept(right)
    small = together(block, x, y)
    if small is not None:
        return in_one_task(small, block, close, False)
    centres = centres_of(y, block)
    xb, yb = cells.blocks(x, block, centres), cells.blocks(y, block, centres)
    xm, ym = cells.bounds(xb), cells.bounds(yb)
    across = ym.count()
    return cells.multiplied(cells.close_tiles(xm, ym, threshold), xb, yb, close, FOUND, xm.count() * across, across)


def rerank(corpus: DataFrame, vector: list[float] | DataFrame, top_k: int = 3, retrieve_k: int = 10, threshold: float = 0.3, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Two stages in one scan: retrieve_k candidates (id, embedding), then the exact product of those and the top_k of it.

    first: gives the candidates' rows of corpus, such as those of an approximate index; by default the closest retrieve_k.
    """
    if first is None:
        near = scored(corpus, vector, "embedding").orderBy(F.desc(F.round("sim", DECIMALS)), "id").limit(retrieve_k).where(F.col("sim") >= threshold)
        exact = near.select("id", "sim")
    else:
        exact = scored(first(corpus), vector).where(F.col("sim") >= threshold)
    return exact.orderBy(F.desc(F.round("sim", DECIMALS)), "id").limit(top_k).select("id", F.round("sim", 4).alias("similarity"))


def lsh_pairs(vectors: DataFrame, threshold: float, bucket_length: float = 0.5, tables: int = 4, seed: int = 42) -> DataFrame:
    """Approximate pairs() for tables beyond all-pairs work: bucketed random projections, then the exact product."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(v)
    near = model.approxSimilarityJoin(v, v, (2 * (1 - threshold)) ** 0.5 + 1e-6, "dist").where("datasetA.id < datasetB.id")
    near = near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), dot("datasetA.embedding", "datasetB.embedding").alias("sim"))
    return near.where(F.col("sim") >= threshold)
