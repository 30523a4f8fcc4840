"""Entities of texts by patterns and word lists; another extractor can be put in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import col

# The labels of entities.
LABELS = ["person", "location", "organization", "money", "technology", "date", "event"]
#: What the default extractor finds, by label. Not equivalent to a trained model: names without a title aren't found.
PATTERNS = {
    "person": r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+",
    "organization": r"\b[A-Z][A-Za-z]+ (?:Inc|Ltd|Corp|GmbH|LLC)\b",
    "money": r"[$€£¥]\s?[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,.]*[万亿千百]",
    "technology": r"\b(?:Apache|Creative Commons|GNU|Linux|MIT|Python|Spark)\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}
ENTITIES = "array<struct<text:string,label:string>>"


def extract(text: Column | str, patterns: dict[str, str] = PATTERNS, words: dict[str, list[str]] | None = None) -> Column:
    """Entities (text, label) by label, in the order of the text, each once; words: further ones by label, whole words."""
    every = dict(patterns)
    for label, listed in (words or {}).items():
        found = r"\b(?:" + "|".join(rf"\Q{w}\E" for w in listed) + r")\b"
        every[label] = f"{every[label]}|{found}" if label in every else found
    of = lambda label, p: F.transform(F.array_distinct(F.regexp_extract_all(col(text), F.lit(p), 0)), lambda t: F.struct(t.alias("text"), F.lit(label).alias("label")))
    return F.coalesce(F.concat(*[of(label, every[label]) for label in sorted(every, key=lambda x: LABELS.index(x) if x in LABELS else len(LABELS))]), F.array().cast(ENTITIES))


def enriched(memories: DataFrame, extractor: Callable[[Column], Column] = extract) -> DataFrame:
    """memories with the entities of their texts; where none are found, the entities that are there stay.

    extractor: gives a column of (text, label) for a column of texts, such as a pandas_udf of a trained model.
    """
    found = extractor(F.coalesce("text", F.lit("")))
    old = F.col("entities") if "entities" in memories.columns else F.lit(None).cast(ENTITIES)
    rows = memories.withColumn("_found", found)
    return rows.withColumn("entities", F.when(F.size("_found") > 0, F.col("_found")).otherwise(old)).drop("_found")
