"""Vectors grouped into cells of like directions, blocks of a cell with bounds, and the pairs of blocks that can matter.

Centres are learnt by spherical k-means over a bounded sample; every vector goes to its nearest centre, and the rows of a
cell are packed into matrices of `block` rows. A block knows the direction of its mean, the largest angle r of a row to it
and the largest length. By the triangle inequality for angles no pair of rows of two blocks has a larger inner product than
length * length * cos(max(0, angle - r - r)), so pairs of blocks below a threshold are never multiplied, and nothing is lost.
Blocks lie in tiles of up to TILE_BYTES. Pairs of tiles are compared by bounds and dealt by keys, then the blocks that a pair
of tiles needs are sent to it, each once, and multiplied there. So a block moves as often as there are tiles, and tables of up
to TILES * TILE_BYTES have TILES of them, small ones too: what is moved grows with the table. No plan has a Cartesian product, and a task holds
the right tile, while the blocks of the left one pass by. Where only rows with smaller ids count, rows are packed in the
order of ids instead of cells, and blocks without such rows don't meet: that leaves out half, whatever the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.sources.held import held

#: The sample that centres are learnt from, the most centres there are, and rounds of k-means.
SAMPLE_ROWS, MAX_CELLS, ROUNDS = 65_536, 4096, 6
#: Tables of up to so many blocks aren't clustered: all their pairs of blocks are a few tasks.
FEW_BLOCKS = 4
#: A tile has so many blocks and bytes at most (but one block at least); a table has TILES tiles, fewer if they'd be smaller than LEAST_BYTES.
GROUP, TILE_BYTES, TILES, LEAST_BYTES = 1024, 96 << 20, 8, 1 << 16
#: A block has so many bytes at most (but one row), as rows of a table are read many at a time.
BLOCK_BYTES = 1 << 19
#: So many rows of one tile are multiplied with CHUNK of another at once.
STRIP, CHUNK = 2048, 4096
#: Room for rounding in bounds; far above the error of sums of doubles.
SLACK = 1e-7
BLOCK = "block bigint, cell int, ids array<bigint>, dims int, matrix binary, centre binary, radius double, length double"
_block = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("dims", pa.int32()), ("matrix", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()), ("length", pa.float64())])


def matrix_of(lists: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column as float64; vectors of unequal length are an error that says so."""
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError(f"vectors have {sizes.min()} to {sizes.max()} numbers; all must have as many")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of rows; a zero row stays zero."""
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n > 0, n, 1)[:, None], n


def sample_of(vectors: DataFrame, n: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` of n rows, by a hash of their ids, so that reruns agree."""
    if n <= rows:
        return vectors
    return vectors.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(m @ centres.T, 1) if len(centres) > 1 else np.zeros(len(m), np.int64)


def learn_centres(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """cells x dims unit centres of (id, embedding), by k-means on directions; centres without rows go, so there may be fewer.

    Every round sums up rows by cell where they lie; cells x dims numbers come back.
    """
    cells = min(cells, MAX_CELLS)
    rows = held(vectors.where("embedding is not null").select("id", "embedding"), "sample")
    first = rows.orderBy(F.xxhash64("id", F.lit("first")), "id").limit(cells).toArrow().column("embedding").combine_chunks()
    if not len(first):
        return np.zeros((0, 0))
    centres = np.unique(units(matrix_of(first))[0], axis=0)
    schema = pa.schema([("cell", pa.int32()), ("total", pa.binary())])
    for _ in range(rounds if len(centres) > 1 else 0):
        now = centres

        def part(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(now.shape)
            for whole_batch in batches:
                for a in range(0, whole_batch.num_rows, 1024):
                    m = units(matrix_of(whole_batch.slice(a, 1024).column("embedding")))[0]
                    np.add.at(total, nearest(m, now), m)
            full = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([total[i].tobytes() for i in full], pa.binary())], schema=schema)

        def whole(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("total"))
            return pa.Table.from_pydict({"cell": [group.column("cell")[0].as_py()], "total": [total.tobytes()]}, schema=schema)

        sums = rows.mapInArrow(part, "cell int, total binary").groupBy("cell").applyInArrow(whole, "cell int, total binary").orderBy("cell").toArrow()
        centres = units(np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in sums.column("total")]))[0]
        if centres.shape == now.shape and np.abs(centres - now).max() < 1e-6:
            break
    return centres


def with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, embedding, cell. Null vectors go."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                cell = nearest(matrix_of(batch.column("embedding")), centres)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cell, pa.int32())], names=["id", "embedding", "cell"])

    return vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(place, f"id bigint, embedding {kind}, cell int")


def pack(batches: Iterator[pa.RecordBatch], block: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows (id, embedding, cell), of one cell each; kind: of a matrix's numbers."""
    part, count = TaskContext.get().partitionId(), 0
    ids, parts, cell, have = [], [], None, 0

    def close() -> pa.RecordBatch:
        nonlocal count
        m = np.concatenate(parts)
        u, n = units(m)
        mean = u.sum(0)
        mean = mean / (np.sqrt((mean * mean).sum()) or 1.0)
        near = np.clip(u[n > 0] @ mean, -1, 1)
        row = {"block": (part << 32) + count, "cell": cell, "ids": np.concatenate(ids), "dims": m.shape[1], "matrix": m.astype(kind).tobytes(), "centre": mean.tobytes(), "radius": float(np.arccos(near.min())) if len(near) else 0.0, "length": float(n.max())}
        count += 1
        return pa.RecordBatch.from_pylist([row], schema=_block)

    for batch in batches:
        cells, m, own, a = batch.column("cell").to_numpy(), matrix_of(batch.column("embedding")), batch.column("id").to_numpy(), 0
        if len(cells):
            block = max(1, min(block, BLOCK_BYTES // max(1, m.shape[1] * np.dtype(kind).itemsize)))
        while a < len(cells):
            if cell is not None and (cells[a] != cell or have >= block):
                yield close()
                ids, parts, have = [], [], 0
            cell = int(cells[a])
            b = min(int(np.searchsorted(cells, cell, "right")), a + block - have)
            ids.append(own[a:b])
            parts.append(m[a:b])
            have, a = have + b - a, b
    if have:
        yield close()


def cells_for(n: int, block: int) -> int:
    """How many cells n rows get: about two blocks each, 1 if there are few."""
    return 1 if n <= FEW_BLOCKS * block else min(MAX_CELLS, -(-n // (2 * block)) * 2)


def blocks(vectors: DataFrame, block: int, centres: np.ndarray | None = None, by_id: bool = False) -> DataFrame:
    """BLOCK rows of (id, embedding), written to the shared folder: they are read by several joins.

    centres: of the cells; None or one: rows are packed as they lie, or by_id: in the order of ids.
    """
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    run = lambda batches: pack(batches, block, kind)
    if by_id:
        n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding", F.lit(0).alias("cell"))
        rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    elif centres is None or len(centres) < 2:
        rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding", F.lit(0).alias("cell"))
    else:
        key = ["cell", "id"]
        placed = held(with_cells(vectors, centres), "placed")
        n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = placed.repartitionByRange(n, *key).sortWithinPartitions(*key)
    return held(rows.mapInArrow(run, BLOCK), "blocks")


def bounds(blocks_: DataFrame) -> DataFrame:
    """grp, the bounds of the blocks of a tile: what pairs of blocks are chosen by. Blocks that follow each other share a tile."""
    meta = blocks_.select("block", "centre", "radius", "length", F.length("matrix").alias("bytes"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"))
    schema = pa.schema([("grp", pa.int64()), ("blocks", pa.list_(pa.int64())), ("dims", pa.int32()), ("centres", pa.binary()), ("radii", pa.list_(pa.float64())), ("lengths", pa.list_(pa.float64())), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64()))])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            tile = np.cumsum(whole.column("bytes").to_numpy()) // TILE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), whole.num_rows]
            for a, z in ((c, e) for c, e in zip(cuts, cuts[1:], strict=False) if e > c):
                for at in range(a, z, GROUP):
                    b = whole.slice(at, min(GROUP, z - at))
                    joined = b"".join(b.column("centre").to_pylist())
                    yield pa.RecordBatch.from_pylist([{"grp": (part << 20) + k, "blocks": b.column("block").to_pylist(), "dims": len(joined) // 8 // b.num_rows, "centres": joined, "radii": b.column("radius").to_pylist(), "lengths": b.column("length").to_pylist(), "lows": b.column("low").to_pylist(), "highs": b.column("high").to_pylist()}], schema=schema)
                    k += 1

    n, size = meta.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    together = meta.repartitionByRange(max(1, min(n, max(min(TILES, size // LEAST_BYTES), -(-size // TILE_BYTES)))), "block").sortWithinPartitions("block")
    return held(together.mapInArrow(group, "grp bigint, blocks array<bigint>, dims int, centres binary, radii array<double>, lengths array<double>, lows array<bigint>, highs array<bigint>"), "bounds")


def most(a: np.ndarray, ra: np.ndarray, la: np.ndarray, b: np.ndarray, rb: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The largest inner product that a row of each block a can have with a row of each block b."""
    angle = np.arccos(np.clip(a @ b.T, -1, 1)) - ra[:, None] - rb[None, :]
    return np.maximum(np.cos(np.maximum(angle, 0)), 0) * la[:, None] * lb[None, :] + SLACK


def chosen_pairs(left: DataFrame, right: DataFrame, choose: Callable, result: str, same: bool = False) -> DataFrame:
    """What choose(left bounds row, right bounds row) gives of each pair of tiles; same: of unordered pairs.

    Pairs of tiles are made by keys: each left tile is sent to the tiles of the right one by name, which are few.
    """
    names = [r.grp for r in right.select("grp").collect()]  # one for TILE_BYTES
    theirs = F.explode(F.array(*[F.lit(x) for x in names]).cast("array<bigint>"))
    pairs = left.withColumn("other", theirs)
    if same:
        pairs = pairs.where("grp <= other")
    r = right.select(F.col("grp").alias("other"), *[F.col(c).alias(f"{c}2") for c in right.columns if c != "grp"])
    return pairs.join(r, "other").repartition("grp", "other").mapInArrow(lambda batches: (choose(b.slice(i, 1)) for b in batches for i in range(b.num_rows)), result)


def of_bounds(row: pa.RecordBatch, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: row.column(f"{c}{s}")[0]
    ids = get("blocks").values.to_numpy()
    return ids, np.frombuffer(get("centres").as_buffer(), np.float64).reshape(len(ids), -1), get("radii").values.to_numpy(), get("lengths").values.to_numpy()


PAIR = "block bigint, block2 bigint"
_pair = pa.schema([("block", pa.int64()), ("block2", pa.int64())])
NEED = "grp bigint, other bigint, side int, block bigint, at int, bits binary, least double"
_need = pa.schema([("grp", pa.int64()), ("other", pa.int64()), ("side", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("bits", pa.binary()), ("least", pa.float64())])


def close_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """block, block2: pairs of blocks with rows that may have an inner product of threshold or more; same: of one table, unordered."""

    def choose(row: pa.RecordBatch) -> pa.RecordBatch:
        (i, *a), (j, *b) = of_bounds(row, ""), of_bounds(row, "2")
        ok = most(*a, *b) >= threshold if threshold > 0 else np.ones((len(i), len(j)), bool)
        x, y = np.nonzero(ok)
        x, y = i[x], j[y]
        if same:
            one = row.column("grp")[0].as_py() == row.column("other")[0].as_py()
            keep = x <= y if one else np.ones(len(x), bool)
            x, y = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=_pair)

    return chosen_pairs(bounds(left), bounds(right), choose, PAIR, same)


def needs(row: pa.RecordBatch, i: np.ndarray, j: np.ndarray, ok: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
    """NEED rows of a pair of tiles with the blocks i and j: ok tells which meet. Blocks that meet none aren't needed.

    A left block (side 0) has a bit for each right one by its place (at) in its tile, and the least product of use to it.
    """
    x, y = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    grp, other = row.column("grp")[0].as_py(), row.column("other")[0].as_py()
    low = np.full(len(i), -np.inf) if least is None else least
    bits = [np.packbits(r).tobytes() for r in ok[x]] + [None] * len(y)
    n = len(x) + len(y)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, grp), pa.int64()), pa.array(np.full(n, other), pa.int64()), pa.array(np.repeat([0, 1], [len(x), len(y)]), pa.int32()), pa.array(np.concatenate([i[x], j[y]]), pa.int64()),
        pa.array(np.concatenate([x, y]), pa.int32()), pa.array(bits, pa.binary()), pa.array(np.concatenate([low[x], np.full(len(y), -np.inf)]), pa.float64()),
    ], schema=_need)


def close_tiles(left: DataFrame, right: DataFrame, threshold: float, same: bool = False, before: bool = False) -> DataFrame:
    """NEED rows of all pairs of tiles with rows that may have an inner product of threshold or more, from their bounds; same: of one table, unordered.

    before: only rows of the right table with smaller ids count.
    """

    def choose(row: pa.RecordBatch) -> pa.RecordBatch:
        (i, *a), (j, *b) = of_bounds(row, ""), of_bounds(row, "2")
        ok = most(*a, *b) >= threshold if threshold > 0 else np.ones((len(i), len(j)), bool)
        if before:
            ok &= row.column("highs")[0].values.to_numpy()[:, None] > row.column("lows2")[0].values.to_numpy()
        return needs(row, i, j, ok)

    return chosen_pairs(left, right, choose, NEED, same)


def multiplied(need: DataFrame, left: DataFrame, right: DataFrame, work: Callable, result: str, tiles: int, across: int | None = None) -> DataFrame:
    """work(ids, matrix, ids, matrix, same tile?, least by row) of what meets by the NEED rows, as the columns of result.

    Each block is joined with the pairs of tiles that need it and goes there once; tiles: how many pairs there are at most; across:
    how many tiles the right table has, if that isn't the root.
    Left blocks that meet the same right ones are one matrix of up to STRIP rows, the right ones one of up to CHUNK. The
    right blocks of a pair of tiles come first and are held, the left ones are multiplied as they come.
    work.merge, if there is one, makes one result of those of a strip with all chunks of a tile, and work.reached tells
    from it what other chunks must have at least.
    """
    merge, reached = getattr(work, "merge", None), getattr(work, "reached", None)
    own = ["block", "ids", "dims", "matrix"]
    met = need.where("side = 0").join(left.select(*own), "block").unionByName(need.where("side = 1").join(right.select(*own), "block"))
    # tiles are (partition << 20) + number, mostly 0, so each pair has a task of its own, as far as there are so many
    n, side = max(1, min(tiles, 4096)), across or math.isqrt(max(1, tiles))
    task = F.shiftright("grp", 20) * side + F.shiftright("other", 20) + F.col("grp") % (1 << 20) * 7 + F.col("other") % (1 << 20) * 3
    met = met.repartitionById(n, F.pmod(task, F.lit(n)).cast("int")).sortWithinPartitions("grp", "other", F.desc("side"), "bits", "at")
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in result.split(", ")])

    def batch_of(out: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    def stacked(blocks_: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([b[0] for b in blocks_]), np.concatenate([b[1] for b in blocks_])

    def strips(blocks_: list, most_rows: int) -> Iterator[list]:
        now, have = [], 0
        for b in blocks_:
            if now and have + len(b[0]) > most_rows:
                yield now
                now, have = [], 0
            now, have = [*now, b], have + len(b[0])
        if now:
            yield now

    def multiplied_by(one: bool, theirs: dict[int, tuple], bits: bytes, strip: list) -> Iterator[pa.RecordBatch]:
        right_ = [theirs[at] for at in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).tolist()]
        ids, m = stacked(strip)
        least, found = np.concatenate([np.full(len(b[0]), b[2]) for b in strip]), None
        for chunk in strips(right_, CHUNK):
            ids2, m2 = stacked(chunk)
            if m.shape[1] != m2.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} and {m2.shape[1]} numbers; all must have as many")
            out = work(ids, m, ids2, m2, one, least)
            if merge is None:
                yield batch_of(out)
            elif found is None or len(out[0]):
                found = merge(*(out if found is None else (np.concatenate(x) for x in zip(found, out, strict=True))))
                least = least if reached is None else reached(ids, found, least)
        if found is not None:
            yield batch_of(found)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, theirs, mine, have, of_mine = None, {}, [], 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i]  # noqa: B023, E731
                now, bits, ids = (of("grp").as_py(), of("other").as_py()), of("bits").as_py(), of("ids").values.to_numpy()
                if mine and (now != key or bits != of_mine or have + len(ids) > STRIP):
                    yield from multiplied_by(key[0] == key[1], theirs, of_mine, mine)
                    mine, have = [], 0
                if now != key:
                    theirs = {}
                ids, data, dims = ids.copy(), of("matrix").as_py(), of("dims").as_py()
                m = np.frombuffer(data, np.float64 if len(data) == 8 * len(ids) * dims else np.float32).reshape(-1, dims)
                key, of_mine = now, bits
                if of("side").as_py():
                    theirs[of("at").as_py()] = (ids, m)
                else:
                    mine.append((ids, m, of("least").as_py()))
                    have += len(ids)
        if mine:
            yield from multiplied_by(key[0] == key[1], theirs, of_mine, mine)

    return met.mapInArrow(multiply, result)


def meeting(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """NEED rows of pairs of blocks (block, block2), by their tables' bounds."""
    of = lambda b, *names: b.select("grp", F.posexplode("blocks").alias("at", "block")).toDF(*names)
    placed = pairs.join(of(left, "grp", "at", "block"), "block").join(of(right, "other", "at2", "block2"), "block2")
    low = F.lit(-float("inf")).alias("least")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for places in batch.column("places").to_pylist():
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                rows.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "other", "block", "at")), pa.array(rows, pa.binary())], names=["grp", "other", "block", "at", "bits"])

    mine = placed.groupBy("grp", "other", "block", "at").agg(F.collect_list("at2").alias("places"))  # GROUP at most
    mine = mine.mapInArrow(bits, "grp bigint, other bigint, block bigint, at int, bits binary")
    theirs = placed.select("grp", "other", F.col("block2").alias("block"), F.col("at2").alias("at")).distinct()
    mine = mine.select("grp", "other", F.lit(0).alias("side"), "block", "at", "bits", low)
    return mine.unionByName(theirs.select("grp", "other", F.lit(1).alias("side"), "block", "at", F.lit(None).cast("binary").alias("bits"), low))
