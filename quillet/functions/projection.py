"""An embedder that learns from a corpus: a randomised singular value decomposition of its TF-IDF matrix.

Texts are rows of hashed token counts times inverse document frequencies, of unit length. The leading right singular
vectors are found by subspace iteration from a random start: each round multiplies the matrix and its transpose with a
block of `dims + EXTRA` vectors where the rows lie, sums the products up by ranges of buckets, and makes the block
orthonormal again. What comes to the driver has buckets x (dims + EXTRA) numbers, whatever the corpus; all texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import tokens
from quillet.sources.held import held

#: More vectors than are kept make the leading ones exact.
EXTRA = 16
#: Numbers in a step's products, and rows of the block that are summed up together.
STEP, RANGE = 1 << 22, 512
#: Rows are a dense matrix if one number in so many isn't zero.
DENSE = 64


def bucketed(texts: DataFrame, buckets: int) -> DataFrame:
    """id, the buckets of its tokens."""
    t = tokens(F.coalesce("text", F.lit("")))
    return texts.select("id", F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")).alias("buckets"))


def counted(texts: DataFrame, buckets: int) -> DataFrame:
    """id, the distinct buckets of a text's tokens and how often each occurs: what learn() and embed() also take for (id, text)."""
    rows = bucketed(texts, buckets)
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                lists = batch.column("buckets")
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                at, n = np.unique(row * buckets + lists.flatten().to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(at, np.arange(len(lists) + 1) * buckets), pa.int32())
                of = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at % buckets, n)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *of], names=["id", "buckets", "counts"])

    return rows.mapInArrow(count, f"id {kind}, buckets array<int>, counts array<int>")


def sparse(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of what isn't zero in unit rows of counts times weight, in order of rows."""
    lists = batch.column("buckets")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    bucket = lists.flatten().to_numpy()
    value = batch.column("counts").flatten().to_numpy() * weight[bucket]
    length = np.sqrt(np.bincount(row, value * value, len(lists)))
    return row, bucket, value / np.where(length > 0, length, 1)[row]


def dense(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int, buckets: int) -> np.ndarray | None:
    """The matrix of sparse(), if so much of it isn't zero that it is multiplied faster whole."""
    if len(row) * DENSE < rows * buckets or rows * buckets > STEP:
        return None
    m = np.zeros((rows, buckets))
    m[row, bucket] = value
    return m


def times(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, block: np.ndarray, rows: int) -> np.ndarray:
    """The rows' products with a block of vectors."""
    m = dense(row, bucket, value, rows, len(block))
    if m is not None:
        return m @ block
    out, width = np.zeros((rows, block.shape[1])), max(1, STEP // block.shape[1])
    for a in range(0, len(row), width):
        r = row[a : a + width]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[first]] += np.add.reduceat(value[a : a + width, None] * block[bucket[a : a + width]], first)
    return out


def there_and_back(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, block: np.ndarray, rows: int) -> np.ndarray:
    """The transpose of the rows times their products with a block of vectors."""
    m = dense(row, bucket, value, rows, len(block))
    if m is not None:
        return m.T @ (m @ block)
    y = times(row, bucket, value, block, rows)
    order = np.argsort(bucket, kind="stable")
    return times(bucket[order], row[order], value[order], y, len(block))


def parts(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    rows = max(1, min(1024, STEP // len(weight)))
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            yield batch, *sparse(batch, weight)


class Projection:
    """weight: of each bucket; basis: buckets x dims; values: the singular values."""

    def __init__(self, weight: np.ndarray, basis: np.ndarray, values: np.ndarray):
        self.weight, self.basis, self.values = weight, basis, values

    @classmethod
    def learn(cls, texts: DataFrame, dims: int = 128, buckets: int = 1 << 14, rounds: int = 4, seed: int = 1) -> Projection:
        """From (id, text), or counted() of it that is written already. rounds: of subspace iteration."""
        rows = texts if "counts" in texts.columns else held(counted(texts, buckets), "buckets")
        n, df = rows.count(), np.zeros(buckets)

        def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sum((np.bincount(b.column("buckets").flatten().to_numpy(), minlength=buckets) for b in batches), np.zeros(buckets, np.int64))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"b": pa.array(at, pa.int32()), "n": pa.array(found[at], pa.int64())})

        for r in rows.mapInArrow(having, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():  # buckets rows
            df[r.b] = r.n
        weight = np.log((n + 1) / (df + 1))
        width = min(dims + EXTRA, buckets)
        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
        schema = pa.schema([("range", pa.int32()), ("data", pa.binary())])

        def summed(part) -> np.ndarray:
            """The sum over all tasks of a matrix that each makes of its rows; sums are made by ranges of the matrix's rows."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m = part(batches)
                for i in range(0, len(m), RANGE):
                    if m[i : i + RANGE].any():
                        yield pa.RecordBatch.from_pydict({"range": [i], "data": [m[i : i + RANGE].tobytes()]}, schema=schema)

            def add(group: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("data"))
                return pa.Table.from_pydict({"range": [group.column("range")[0].as_py()], "data": [total.tobytes()]}, schema=schema)

            got = rows.mapInArrow(run, "range int, data binary").groupBy("range").applyInArrow(add, "range int, data binary").collect()
            out = np.zeros(part(iter(())).shape)
            for r in got:
                x = np.frombuffer(r.data, np.float64).reshape(-1, out.shape[1])
                out[r.range : r.range + len(x)] = x
            return out

        for _ in range(rounds):
            now = block

            def back(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> np.ndarray:
                out = np.zeros(now.shape)
                for batch, row, bucket, value in parts(batches, weight):
                    out += there_and_back(row, bucket, value, now, batch.num_rows)
                return out

            block = np.linalg.qr(summed(back))[0]
        last = block

        def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((width, width))
            for batch, row, bucket, value in parts(batches, weight):
                y = times(row, bucket, value, last, batch.num_rows)
                out += y.T @ y
            return out

        squares, turn = np.linalg.eigh(summed(gram))
        best = np.argsort(-squares)[:dims]
        basis = last @ turn[:, best]
        basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])  # the same again
        return cls(weight, basis, np.sqrt(np.maximum(squares[best], 0)))

    def embed(self, texts: DataFrame) -> DataFrame:
        """id, embedding: unit vectors of (id, text), or of counted() of it; zero for texts without known tokens."""
        weight, basis = self.weight, self.basis
        rows = texts if "counts" in texts.columns else counted(texts, len(weight))
        kind = rows.schema["id"].dataType.simpleString()

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row, bucket, value in parts(batches, weight):
                v = times(row, bucket, value, basis, batch.num_rows)
                n = np.sqrt((v * v).sum(1, keepdims=True))
                v = (v / np.where(n > 1e-12, n, 1)).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "embedding"])

        return rows.mapInArrow(vectors, f"id {kind}, embedding array<float>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, len(m), bytearray(np.ascontiguousarray(m, np.float64).tobytes())) for k, m in (("weight", self.weight), ("basis", self.basis), ("values", self.values))]
        spark.createDataFrame(rows, "what string, rows int, data binary").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Projection:
        got = {r.what: np.frombuffer(r.data, np.float64).reshape(r.rows, -1) for r in spark.read.parquet(path).collect()}
        return cls(got["weight"].ravel(), got["basis"], got["values"].ravel())
