"""Vector expressions, and a hashed TF-IDF embedder for tables without vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import col, tokens
from quillet.sources.held import held


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, in element order; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def embed(texts: DataFrame, id_col: str = "id", text_col: str = "text", dims: int = 1024, idf: bool = True) -> DataFrame:
    """id, embedding: unit vectors of hashed token counts times ln((N + 1) / (df + 1)); zero for texts without tokens.

    idf: False leaves the factor out, so that a text's vector doesn't depend on the other texts.

    Tokens are hashed in the JVM; a text's buckets become its vector in one array operation. df is one row per bucket.
    """
    base = texts.select(F.col(id_col).alias("id"), F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")).alias("buckets"))
    kind, weight = base.schema["id"].dataType.simpleString(), np.ones(dims)
    if idf:
        base = held(base, "buckets")
        df, n = np.zeros(dims), base.count()
        for r in base.select(F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).collect():  # dims rows at most
            df[r.bucket] = r.df
        weight = np.log((n + 1) / (df + 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                lists, rows = batch.column("buckets"), min(1024, whole.num_rows - a)
                at = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy())) * dims + lists.flatten().to_numpy()
                v = np.bincount(at, minlength=rows * dims).reshape(rows, dims) * weight
                norm = np.sqrt((v * v).sum(1, keepdims=True))
                v = (v / np.where(norm > 0, norm, 1)).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dims, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "embedding"])

    return base.mapInArrow(vectors, f"id {kind}, embedding array<float>")
