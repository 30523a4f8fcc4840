"""Time to live by tag, and when a memory is due for the archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.text import col

# Days by tag, and for memories without such a tag.
TAG_DAYS = {"static": 365, "dynamic": 180, "temporary": 30, "preference": 365, "feedback": 365, "reference": 365}
DEFAULT_DAYS = 180
DAY_US = 86_400_000_000


def ttl_of(tags: Column | str) -> Column:
    """The shortest time of the tags that have one."""
    days = F.create_map(*[F.lit(x) for kv in TAG_DAYS.items() for x in kv])
    return F.coalesce(F.array_min(F.transform(col(tags), lambda t: days[t])), F.lit(DEFAULT_DAYS))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Full days between two times, rounded down."""
    return F.floor((F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(DAY_US))


def days_later(time: Column | str, days: Column | str) -> Column:
    return F.timestamp_micros(F.unix_micros(col(time)) + col(days).cast("long") * F.lit(DAY_US))


def due(now: Column) -> Column:
    """Whether a memory (created_at, expire_at, ttl_days, tags) is archived at now; never without created_at."""
    by_age = whole_days("created_at", now) > F.coalesce(F.col("ttl_days"), ttl_of("tags"))
    late = F.when(F.col("expire_at").isNotNull(), now > F.col("expire_at")).otherwise(by_age)
    return F.coalesce(F.col("created_at").isNotNull() & late, F.lit(False))
