"""Tokens, keywords, overlap, and the parsing of tags and entities; all Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not tokens, and the pattern of tokens.
STOPWORDS = ["的", "是", "在", "了", "有", "不", "也", "都", "就", "但", "而", "与", "或", "我", "你", "他", "她", "它", "这", "那", "一个", "可以", "没有", "已经", "the", "and", "for", "with", "this", "that", "from", "has", "was", "is"]
TOKEN = r"[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{3,}|[\p{Nd},.]+[万亿千百%]?"
# Words that are not keywords (compared before lower-casing).
KEYWORD_STOPWORDS = [
    "包括但不限于", "对于", "以及", "关于", "所有", "这些", "一个", "一种", "这个", "那个", "已经", "可以", "需要", "必须", "不能", "不是", "没有", "不会", "应该", "可能", "但是", "因为", "所以", "如果", "虽然", "而且", "或者", "然后", "那么", "这样",
    "的", "是", "在", "和", "了", "有", "不", "也", "都", "就", "但", "而", "与", "或", "着", "过", "把", "被", "让", "给", "对", "从", "到", "上", "下", "中", "里", "很", "非常", "比较", "更加", "最", "太", "还", "再", "又", "我", "你", "他", "她", "它", "我们", "你们", "他们",
    "the", "and", "for", "with", "this", "that", "from", "has", "was",
]
MAX_KEYWORDS = 25


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))  # so many literals become a hash set


def tokens(text: Column | str) -> Column:
    """Lower-case tokens in order, repeats kept; null for null."""
    return without(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), 0), STOPWORDS)


def runs(text: Column) -> Column:
    """The default segmenter: runs of one kind of character."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def keywords(text: Column | str, segment: Callable[[Column], Column] = runs) -> Column:
    """The first 25 distinct keywords, in order. segment: gives the words of a text column, such as a pandas_udf of a word segmenter."""
    found = without(segment(col(text)), KEYWORD_STOPWORDS)
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, MAX_KEYWORDS)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two sets of keywords; 0 if both are empty."""
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.size(F.array_union(col(a), col(b))), F.lit(1))


def parse_tags(raw: Column | str) -> Column:
    """Tags from a JSON array, or else from a comma list: trimmed, empty ones dropped. Null and empty give none."""
    raw = col(raw)
    listed = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), listed)


def parse_entities(raw: Column | str) -> Column:
    """text:label parts between bars, cut at the last colon; a part without a colon has the label unknown."""
    parts = F.filter(F.split(F.coalesce(col(raw), F.lit("")), r"\|"), lambda x: x != "")
    cut = lambda x, i: F.regexp_extract(x, "(?s)^(.*):([^:]*)$", i)
    return F.transform(
        parts,
        lambda x: F.struct(
            F.when(F.contains(x, F.lit(":")), cut(x, 1)).otherwise(x).alias("text"), F.when(F.contains(x, F.lit(":")), cut(x, 2)).otherwise(F.lit("unknown")).alias("label")
        ),
    )


def format_entities(entities: Column | str) -> Column:
    return F.array_join(F.transform(col(entities), lambda e: F.concat_ws(":", e["text"], e["label"])), "|")
