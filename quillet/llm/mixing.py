"""Mixing sources to target weights. DataFrame functions only.

Every document gets a hash-random key. The key's range is cut into buckets, so that within each source the buckets are
ranges of keys with a bounded number of rows each: a hot source is many buckets. Bucket totals are summed up in key
order within each source, and a running sum inside a bucket starts from its bucket's offset: a prefix sum of token
counts that no task computes alone. The source's budget then cuts exactly, in the middle of a document if need be;
whole passes over the source come first where the budget exceeds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import WORD, column_of, keyed, n_words, stage, with_key

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for rows (source, source_size): one row per source, so this table is small.

    The sources in code-point order, null last, weigh `weights`, repeating. They share `share` of all sizes by
    weight, but a source gets `most` times its size at most; the excess is shared by weight again, until none is above.
    That is target = min(cap, level x weight): with sources in order of cap / weight, those up to some place are at
    their cap and level follows from what is left. share must not exceed most.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
            "before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("before")) / F.col("weights")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    least = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(least.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), least * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def hash_key(*cols: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
    bucket_rows: int = 4096,
) -> DataFrame:
    """One row per row of docs: rid, doc_id, source, size, source_size, target, taken.

    size: words of the text (null: 0). taken: words that the mix takes of it, repeats counted: floor(target) words are
    taken of each source, whole passes first and then the documents in the order of their keys; the last one is cut.
    A null source is a source of its own. Equal rows count each. The key is a hash of doc_id, source, size and seed
    (ties by scan order), so reruns over the same tables agree. An empty table gives no rows; a source whose documents
    have no words has target 0. bucket_rows: about how many rows one bucket holds.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = stage(rows.select("rid", "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")), "sizes")
    rows = rows.withColumn("key", hash_key("doc_id", "source", "size", seed=seed))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = stage(
        targets(per.select("source", "source_size"), share, most, weights).join(per.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"),
        "targets",
    )
    largest = goal.agg(F.max("rows")).first()[0] or 1
    bits = max(0, (int(largest) // bucket_rows).bit_length())
    # the sign bit is flipped so that buckets are in the order of the signed keys
    bucket = (F.shiftright("key", 64 - bits) if bits else F.lit(0)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    total = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    start = F.col("offset") + F.col("within")
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.join(F.broadcast(goal) if is_small(goal) else goal, F.col("source").eqNullSafe(F.col("s"))).select(
        "rid", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def is_small(table: DataFrame, rows: int = 50_000) -> bool:
    """Whether a staged table has so few rows that it may be broadcast."""
    return table.limit(rows + 1).count() <= rows


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, once for each pass that takes them.

    The document at a source's cut comes last with its first words only, as they stand in its text; documents of
    which nothing is taken go. docs must be a table or staged.
    """
    marked, key = with_key(docs)
    text = column_of(docs, text_col)
    took = mix(docs, id_col, text_col, source_col, **how).where("taken > 0").select(*[F.col(c).alias(f"{key}_{c}") for c in ("rid", "size", "taken")])
    rid, size, taken, cut = (F.col(f"{key}_{c}") for c in ("rid", "size", "taken", "cut"))
    part = taken % size
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(taken / size).cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    joined = marked.join(took, F.col(key) == rid).withColumn(f"{key}_cut", F.explode(copies))
    piece = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"(?s)(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"), 0), F.lit(1), cut.cast("int")), "")
    return joined.withColumn(text, F.when(cut > 0, piece).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
