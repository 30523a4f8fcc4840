"""Conversation turns as memories, and recalled memories as a block of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.text import col, stripped
from quillet.operators.similarity import rerank

# Acknowledgements, and the marks of a recalled block.
ACKNOWLEDGED = r"^(?:嗯|好|ok|继续|go\s*on|next|yes|no|对|行|可以|明白|了解|收到)$"
PUNCTUATION = r"^[!！?？。.]{1,3}$"
BLOCKS = ("memory-context", "session-context")
HEADER = "<memory-context>\n[memory] Contextual recall:\n"
FOOTER = "\n</memory-context>"
FACTS_HEADER = "[memory preserved facts]\n"
TOOL_MOST, TOOL_RETRIEVE = 10, 20
FACTS_QUERY = "key facts decisions commitments preferences"


def without_blocks(text: Column | str) -> Column:
    """Without recalled blocks, so that recall isn't stored again; stripped."""
    t = F.coalesce(col(text), F.lit(""))
    for b in BLOCKS:
        t = F.regexp_replace(t, f"(?s)<{b}>.*?</{b}>", "")
    return stripped(t)


def trivial(text: Column | str) -> Column:
    return col(text).rlike(ACKNOWLEDGED) | col(text).rlike(PUNCTUATION)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, user_text, assistant_text: each user turn with the assistant's next one in the same conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nxt = turns.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), F.col("next_text").alias("assistant_text"))


def turn_memories(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text, source, tags of the pairs worth writing: not those where both sides are trivial."""
    p = turn_pairs(turns).withColumns({"u": without_blocks("user_text"), "a": without_blocks("assistant_text")}).where(~(trivial("u") & trivial("a")))
    text = F.concat(F.lit("User: "), F.col("u"), F.lit("\nAssistant: "), F.col("a"))
    tags = F.array(F.concat(F.lit("session:"), F.col("conv_id").cast("string")), F.lit("source:conversation"))
    return p.select("conv_id", "turn", text.alias("text"), F.lit("conversation").alias("source"), tags.alias("tags"))


def session_tail(turns: DataFrame, last: int = 5, chars: int = 200) -> DataFrame:
    """conv_id, snippet: the last turns of each conversation, cut, joined by a space; empty ones go."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    t = turns.where("text is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.substring("text", 1, chars).alias("text"))))
    s = t.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("snippet"))
    return s.where(stripped("snippet") != "")


def session_memories(turns: DataFrame) -> DataFrame:
    """conv_id, text, source, tags: what the end of each conversation writes."""
    tags = F.array(F.concat(F.lit("session:"), F.col("conv_id").cast("string")), F.lit("session-summary"))
    return session_tail(turns).select("conv_id", F.col("snippet").alias("text"), F.lit("session-end").alias("source"), tags.alias("tags"))


def recall(corpus: DataFrame, vector, top_k: int, retrieve_k: int, threshold: float = 0.3) -> DataFrame:
    """rank, id, similarity and the columns of corpus (id, embedding, text, ...) of the rows closest to a vector, in two stages."""
    near = rerank(corpus, vector, top_k, retrieve_k, threshold)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1)  # top_k rows
    return near.join(corpus.drop("embedding"), "id")


def recall_tool(corpus: DataFrame, vector, top_k: int = 5, threshold: float = 0.3) -> DataFrame:
    """result: what the recall tool answers, JSON of up to 10 rows out of 20 candidates."""
    return tool_result(recall(corpus, vector, min(top_k, TOOL_MOST), TOOL_RETRIEVE, threshold))


def preserved_facts(corpus: DataFrame, vector) -> DataFrame:
    """block: the three closest of ten candidates to the vector of FACTS_QUERY, for what a compressed conversation must keep."""
    return facts_block(recall(corpus, vector, 3, 10, 0.3))


def mirrored(writes: DataFrame) -> DataFrame:
    """text, source, tags of adds and replacements (action, target, content, session_id) of another memory."""
    tags = F.array_compact(F.array(F.concat(F.lit("target:"), F.col("target")), F.lit("source:builtin-memory"), F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("session:"), F.col("session_id")))))
    return writes.where("action in ('add', 'replace')").select(F.col("content").alias("text"), F.lit("builtin-memory").alias("source"), tags.alias("tags"))


def line(text: str = "text", tags: str = "tags", created: str = "created_at") -> Column:
    label = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    head = F.when(label != "", F.concat(F.lit("- ["), label, F.lit("] "))).otherwise(F.lit("- "))
    day = F.date_format(created, "yyyy-MM-dd")
    return F.concat(head, F.col(text), F.when(day.isNotNull(), F.concat(F.lit("  ("), day, F.lit(")"))).otherwise(F.lit("")))


def context_block(recalled: DataFrame, header: str = HEADER, footer: str = FOOTER) -> DataFrame:
    """block: one row, the recalled rows (rank, text, tags, created_at) by rank as a block; empty if there are none."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line().alias("line")))), lambda x: x["line"])
    return recalled.agg(F.when(F.count("*") > 0, F.concat(F.lit(header), F.array_join(lines, "\n"), F.lit(footer))).otherwise("").alias("block"))


def facts_block(recalled: DataFrame) -> DataFrame:
    """block: the recalled texts by rank as a list, for what a compressed conversation must keep."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("text")).alias("line")))), lambda x: x["line"])
    return recalled.agg(F.when(F.count("*") > 0, F.concat(F.lit(FACTS_HEADER), F.array_join(lines, "\n"))).otherwise("").alias("block"))


def tool_result(recalled: DataFrame) -> DataFrame:
    """result: the recalled rows by rank and their count as JSON."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("id", "text", "similarity").alias("r")))), lambda x: x["r"])
    return recalled.agg(F.to_json(F.struct(rows.alias("results"), F.count("*").alias("count"))).alias("result"))
