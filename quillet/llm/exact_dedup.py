"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only.

Each scan partition becomes a run: one row per digest, with the smallest identifier and the number of rows.
In each round, groups of `fan_in` neighbouring runs exchange their rows (by group and digest, so that a group's run is
itself spread over tasks) and merge into one run: the aggregate is sort-based, so each task sorts what has come in and
folds equal digests in one pass, and a run is sorted by digest within each task. (An exchange doesn't keep the order of what it
moves, so Spark sorts anew where a hand-written merge would go on with heads of runs; the rounds and what moves are the same.) a digest keeps its smallest identifier, verified by a second,
independent digest and the length, which must agree at every level. After log_fan_in(runs) rounds one run is left.
A digest sends one row per run at most, so a hot text is pre-aggregated before every exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import SPACE, keyed, stage


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, run (the partition it was read in), text_sha256, and check (a second digest with the length)."""
    norm = keyed(docs, doc_id=id_col, text=text_col).withColumn("norm", normalised(F.col("text")))
    return norm.select(
        "rid",
        "doc_id",
        F.shiftright("rid", 33).alias("run"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.xxhash64("norm", F.octet_length("norm")).alias("check"),
    )


def merge_runs(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per digest from rows (run, text_sha256, check, first, n): the rounds of the merge."""
    last = runs.agg(F.max("run")).first()[0] or 0
    level = sorted_run(runs, F.col("run"))
    while last > 0:
        last //= fan_in
        level = sorted_run(level, F.floor(F.col("run") / fan_in))
    return level


def sorted_run(rows: DataFrame, run: Column) -> DataFrame:
    """Merge the rows of each new run: the smallest identifier, the sum of rows, and the check that must be the same in all."""
    merged = rows.groupBy(run.cast("long").alias("run"), "text_sha256").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("check2")
    )
    verified = F.when(F.col("check") == F.col("check2"), F.col("check")).otherwise(
        F.raise_error(F.concat(F.lit("two texts have one SHA-256: "), F.col("text_sha256"))).cast("long")
    )
    return merged.select("run", "text_sha256", "first", "n", verified.alias("check"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per row of docs: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space became one space; null counts as
    empty. The row with the smallest doc_id stays (a null one comes after all others; of rows with the same doc_id the
    first in scan order stays), so exactly one row of each group is kept. An empty table gives no rows; other columns
    are not read. fan_in: how many runs merge in one round.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    merged = merge_runs(rows.select("run", "text_sha256", "check", first.alias("first"), F.lit(1).cast("long").alias("n")), fan_in)
    keep = merged.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), F.col("n").alias("group_size"))
    return rows.join(keep.hint("merge"), "text_sha256").select(
        "rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; docs must be a table or staged."""
    from quillet.llm.common import with_key

    marked, key = with_key(docs)
    kept = dedup(docs, id_col, text_col).where("kept").select(F.col("rid").alias(key))
    return marked.join(kept, key, "left_semi").drop(key)
