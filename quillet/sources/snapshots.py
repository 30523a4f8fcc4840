"""A mutable table on immutable files: each write is a new snapshot folder, and a pointer names the one that counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.text import stripped
from quillet.schema import MEMORY

#: Appends add a folder each; so many become one.
COMPACT_AT = 64


class Snapshots:
    """A table of `schema` under path; read() gives the last one written, or an empty one.

    A pointer is a numbered JSON file: the folders that make up the table, and marks, the last batch that each stream has
    written. Both change in one step, so a batch is in the table exactly if its mark is. A pointer that isn't whole, of a
    writer that was killed, doesn't count.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = MEMORY):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[int, dict]:
        """The next free number, and the newest whole pointer."""
        p, fs = self._file("pointers")
        names = sorted((x.getPath().getName() for x in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for name in names:
            stream = fs.open(self._file(f"pointers/{name}")[0])
            try:
                return int(names[0]) + 1, json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue
            finally:
                stream.close()
        return (int(names[0]) + 1 if names else 0), {"folders": [], "marks": {}}

    def current(self) -> list[str]:
        """The folders that make up the table."""
        return self._pointer()[1]["folders"]

    def written(self, mark: tuple[str, int] | None) -> bool:
        """Whether a batch (name of the stream, number) is in the table already."""
        return mark is not None and self._pointer()[1]["marks"].get(mark[0], -1) >= mark[1]

    def read(self) -> DataFrame:
        names = self.current()
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame | None, keep: bool, mark: tuple[str, int] | None) -> None:
        if self.written(mark):
            return
        folders = []
        if df is not None:
            folders = [f"v{uuid.uuid4().hex[:12]}"]
            df.write.parquet(f"{self.path}/{folders[0]}")
        n, before = self._pointer()
        now = {"folders": (before["folders"] if keep else []) + folders, "marks": before["marks"] | ({mark[0]: mark[1]} if mark else {})}
        p, fs = self._file("pointers")
        fs.mkdirs(p)
        out = fs.create(self._file(f"pointers/{n:09d}")[0], False)  # a second writer of the same number fails
        try:
            out.write(bytearray(json.dumps(now).encode()))
        finally:
            out.close()

    def write(self, df: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Replace the table by df, which may read the snapshot before. One writer at a time. mark: see written()."""
        self._write(df, False, mark)

    def append(self, df: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Add rows as one more folder; columns that df hasn't are null. What is there isn't written again.

        From COMPACT_AT folders on, the table is written anew as one.
        """
        empty = self.spark.createDataFrame([], self.schema)
        self._write(empty.unionByName(df, allowMissingColumns=True), True, mark)
        if len(self.current()) >= COMPACT_AT:
            self.write(self.read())

    def done(self, mark: tuple[str, int]) -> None:
        """Note a batch that adds nothing."""
        self._write(None, True, mark)


def item(memories: DataFrame) -> Column:
    """One backup item: id, text, metadata."""
    return F.struct("id", "text", F.struct(*[c for c in memories.columns if c not in ("id", "text", "ord", "embedding")]).alias("metadata"))


def export_items(memories: DataFrame) -> DataFrame:
    """ord, value: the backup's items as JSON, a row each, for df.write.text or any other sink."""
    return memories.select("ord", F.to_json(item(memories)).alias("value"))


def export_document(memories: DataFrame, now: Column) -> DataFrame:
    """value: the backup as one JSON document, items in the table's order. For tables that fit one string; else export_items."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item(memories).alias("item")))), lambda x: x["item"])
    doc = F.struct(F.lit(1).alias("schema_version"), now.cast("string").alias("exported_at"), F.count("*").alias("count"), items.alias("items"))
    return memories.agg(F.to_json(doc).alias("value"))


ITEM = "struct<id: string, text: string, metadata: struct<source: string, tags: array<string>>>"


def restored(items: DataFrame, suffix: str = "") -> DataFrame:
    """restored_from_id, text, source, tags of backup items (value: JSON), ready to be written again; empty texts go."""
    rows = items.select(F.from_json("value", ITEM).alias("i"))
    source = F.concat(F.coalesce(F.nullif(F.col("i.metadata.source"), F.lit("")), F.lit("restore")), F.lit(suffix))
    return rows.where(stripped(F.coalesce("i.text", F.lit(""))) != "").select(F.col("i.id").alias("restored_from_id"), F.col("i.text").alias("text"), source.alias("source"), F.col("i.metadata.tags").alias("tags"))


def document_items(backup: DataFrame) -> DataFrame:
    """value: the items of a backup document, a row each."""
    return backup.select(F.explode(F.from_json("value", f"struct<items: array<{ITEM}>>")["items"]).alias("i")).select(F.to_json("i").alias("value"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages from boxes of one JSON file each (path/<box>/msg_*.json); files that aren't JSON go."""
    kind = "id string, `from` string, subject string, body string, timestamp string, status string, ttl_hours int, priority string, ref string, _corrupt_record string"
    m = spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path.rstrip('/')}/*/msg_*.json")
    m = m.withColumn("box", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1)).where("_corrupt_record is null and id is not null")
    return m.select("id", "box", F.col("from").alias("sender"), "subject", "body", F.try_to_timestamp("timestamp").alias("ts"), "status", "ttl_hours", "priority", "ref")
