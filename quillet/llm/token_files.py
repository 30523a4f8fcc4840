"""Token-id output: bit-plane shuffled, compressed blocks of ids with a chunk index.

Format. A data set is a folder with the table `segments`; each row is one self-contained segment, the ids of
consecutive documents in doc_id order (`first_doc`, `doc_ids`, `doc_sizes` in ids, `n_ids`), and its bytes:

    payload = for each block of block_ids ids (the last may be shorter), for each plane, one zstandard frame
    chunks  = the chunk index: for each plane of each block (n_ids, plane, offset, length)

A block's ids are transposed: plane p of a bit shuffle holds bit p of every id, eight ids a byte; plane p of a byte
shuffle holds byte p of every id. Planes above the block's highest bit are not stored. A reader finds a chunk by its
offset alone. Rows are written by Spark with its commit protocol, on whatever file system the folder is, so a
lost executor or a speculative copy leaves no half-written or doubled segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.llm.common import Tokens, keyed, memories

SEGMENT = "part int, segment int, doc_ids array<bigint>, doc_sizes array<bigint>, n_ids bigint, shuffle string, chunks array<struct<n_ids:int,plane:int,offset:bigint,length:int>>, payload binary"
DOCUMENT = "part int, segment int, place int, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def planes(ids: np.ndarray, shuffle: str = "bit") -> list[bytes]:
    """The planes of a block, the lowest first."""
    if shuffle == "byte":
        n = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 0
        return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, p]).tobytes() for p in range(n)]
    n = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1).tobytes() for p in range(n)]


def from_planes(parts: list[bytes], n: int, shuffle: str = "bit") -> np.ndarray:
    """The block of n ids that planes() made parts of."""
    ids = np.zeros(n, np.uint32)
    for p, part in enumerate(parts):
        raw = np.frombuffer(part, np.uint8)
        if shuffle == "byte":
            ids |= raw.astype(np.uint32) << np.uint32(8 * p)
        else:
            ids |= np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(p)
    return ids


def pack(ids: np.ndarray, block_ids: int = 65_536, shuffle: str = "bit", level: int = 3) -> tuple[bytes, list[dict]]:
    """payload and chunk index of a segment."""
    out, index, at, write = [], [], 0, zstandard.ZstdCompressor(level=level).compress
    for a in range(0, len(ids), block_ids):
        block = ids[a : a + block_ids]
        for p, plane in enumerate(planes(block, shuffle)):
            out.append(frame := write(plane))
            index.append({"n_ids": len(block), "plane": p, "offset": at, "length": len(frame)})
            at += len(frame)
    return b"".join(out), index


def unpack(payload: bytes, chunks: list[dict], shuffle: str = "bit") -> np.ndarray:
    """All ids of a segment."""
    read, blocks, i = zstandard.ZstdDecompressor().decompress, [], 0
    while i < len(chunks):
        j = i + 1
        while j < len(chunks) and chunks[j]["plane"]:
            j += 1
        parts = [read(payload[c["offset"] : c["offset"] + c["length"]]) for c in chunks[i:j]]
        blocks.append(from_planes(parts, chunks[i]["n_ids"], shuffle))
        i = j
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    block_ids: int = 65_536,
    segment_ids: int = 1 << 20,
    shuffle: str = "bit",
    level: int = 3,
    partitions: int | None = None,
) -> None:
    """Encode every whole text and write the ids in ascending doc_id order (null first; ties by a hash of the text, then the text) to path.

    A null or empty text is end_id alone. segment_ids: a segment ends after the document that reaches so many ids;
    a longer document is one segment. partitions: of the range sort by doc_id; set by the input's size if None.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("text")  # rows of one id, or without one, are spread over ranges, too
    rows = rows.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), shared_tokens(tokenizer)
        end = np.asarray([] if end_id is None else [end_id], np.uint32)
        segment, ids, sizes, held, total = 0, [], [], [], 0

        def flush():
            payload, index = pack(np.concatenate(held) if held else np.zeros(0, np.uint32), block_ids, shuffle, level)
            row = {"part": part, "segment": segment, "doc_ids": ids, "doc_sizes": sizes, "n_ids": total, "shuffle": shuffle, "chunks": index, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(docs_), 64):
                for d, x in zip(docs_[a : a + 64], tokens.encode(texts.slice(a, 64).to_pylist()), strict=True):
                    held += [x, end]
                    ids.append(d)
                    sizes.append(len(x) + len(end))
                    total += sizes[-1]
                    if total >= segment_ids:
                        yield flush()
                        segment, ids, sizes, held, total = segment + 1, [], [], [], 0
        if ids:
            yield flush()

    chunk = pa.struct([("n_ids", pa.int32()), ("plane", pa.int32()), ("offset", pa.int64()), ("length", pa.int32())])
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("shuffle", pa.string()), ("chunks", pa.list_(chunk)), ("payload", pa.binary())])
    rows.mapInArrow(encode, SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")


_tokens: dict[str, Tokens] = {}
memories.append(_tokens)


def shared_tokens(path: str) -> Tokens:
    """One Tokens for each file and worker process, so that what it remembers serves all its tasks."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index alone: one row per chunk, without reading any payload."""
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    return segments.select("part", "segment", "shuffle", F.explode("chunks").alias("c")).select("part", "segment", "shuffle", "c.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, place, doc_id, ids (array<bigint>) of every document, decoded from the files."""
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def rows(x, ids):
        return {"ids": pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))}

    return decode(spark, path, "part int, segment int, place int, doc_id bigint, ids array<bigint>", schema, rows)


def decode(spark: SparkSession, path: str, ddl: str, schema: pa.Schema, of) -> DataFrame:
    """A row for each document of the data set; of(segment, arrays of ids) gives the columns besides the first four."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                ids = np.split(unpack(x["payload"], x["chunks"], x["shuffle"]), np.cumsum(x["doc_sizes"])[:-1])
                n = len(ids)
                cols = {"part": [x["part"]] * n, "segment": [x["segment"]] * n, "place": list(range(n)), "doc_id": x["doc_ids"]} | of(x, ids)
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return spark.read.schema(SEGMENT).parquet(f"{path}/segments").mapInArrow(parts, ddl)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    start, the ids of all documents before it, is a prefix sum: within a segment by its own sizes, and over segments by
    their totals (one row for each million ids, so the one sorted list of them stays small).
    """
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("within", pa.int64())])

    def rows(x, ids):
        sizes = np.array([len(i) for i in ids], np.int64)
        return {"n_tokens": sizes, "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], "within": np.cumsum(sizes) - sizes}

    docs = decode(spark, path, DOCUMENT + ", within bigint", schema, rows)
    totals = spark.read.schema(SEGMENT).parquet(f"{path}/segments").select("part", "segment", "n_ids")
    by_part = totals.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = by_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("in_part", F.coalesce(F.sum("n_ids").over(here), F.lit(0))).join(parts, F.col("part") == F.col("p"))
    offsets = offsets.select("part", "segment", (F.col("before") + F.col("in_part")).alias("offset"))
    return docs.join(offsets, ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
