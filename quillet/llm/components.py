"""Connected components and the linking of bucket members. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import drop_staged, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, comp for every node of the edges; comp: the smallest id of its component.

    Distributed union-find by alternating large and small stars: each node hands its neighbours the smallest node it
    knows, until the edges are stars around the smallest ids. Every round is staged. Loops and repeated edges are allowed.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    before, old = None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").where("u <> v").distinct(), "stars")
        if old is not None:
            drop_staged(old)
        old = now
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())


def with_components(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """members with comp: their component so far, themselves without one."""
    if comps is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def open_members(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """members, with comp, of the buckets (key) that hold two components or more."""
    now = with_components(members, comps)
    if comps is None:
        return now
    still = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return stage(now.join(still.hint("merge"), "key", "left_semi"), "open")  # it is read several times


def leaders(members: DataFrame, verify: Callable[[DataFrame], DataFrame], ratio: float, rounds: int = 2) -> DataFrame | None:
    """id, comp of ids that leaders link, or None; members: rows (key, id, n, weight), n the size of the id's set, staged.

    In each round every bucket that holds several components compares one leader with its members outside the leader's
    component: the heaviest member at first, then others by a hash. verify takes pairs (a, b) and returns those that are
    linked; sizes that differ by more than ratio can't be. Large groups collapse so in work that is linear in their
    size. What is left apart is the caller's: see open_members.
    """
    near = lambda x, y: F.least(x, y) >= F.lit(ratio) * F.greatest(x, y)
    links, comps = None, None
    for turn in range(rounds):
        now = with_components(members, comps)
        first = F.struct((-F.col("weight") if turn == 0 else F.lit(0)).alias("w"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp", "n")
        per = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(first).alias("lead"))
        pairs = now.join(per.where("low <> high").select("key", "lead").hint("merge"), "key").where((F.col("comp") != F.col("lead.comp")) & near(F.col("n"), F.col("lead.n")))
        pairs = stage(pairs.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():  # a later turn has other leaders
            continue
        found = stage(verify(pairs).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        comps = components(links)
    return comps


def distinct_buckets(members: DataFrame) -> DataFrame:
    """The members (key, id, c, staged) of one bucket of each set of members: the first by band, if there is one, and key."""
    mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    place = F.struct("band", "key") if "band" in members.columns else F.struct("key")
    per = members.groupBy("key").agg(F.first("c").alias("c"), mark(1).alias("x"), mark(2).alias("y"), F.min(place).alias("place"))
    kept = per.groupBy("c", "x", "y").agg(F.min("place").alias("place")).select("place.key")
    return members.join(kept.hint("merge"), "key", "left_semi")


def dealt_blocks(members: DataFrame, block: int) -> DataFrame:
    """members (key, id, c, comp) with low, high, part: who is to be compared with whom.

    A bucket of up to block members is one part, -1. Larger ones are cut into parts of about block members, and each member
    comes once for each pair (low, high) of parts that its part is in. A component with many members in a bucket has parts of
    its own, which needn't be compared with each other; other members are dealt by a hash. So a bucket that one component fills
    costs the pairs of its parts with the rest only. Parts are numbered among the bucket's parts, of which there are
    block times fewer than members.
    """
    few = members.where(F.col("c") <= block).withColumns({x: F.lit(-1) for x in ("low", "high", "part")})
    rows = members.where(F.col("c") > block)
    of = rows.groupBy("key", "comp").agg(F.count("*").alias("m")).withColumn("own", F.when(F.col("m") * 2 >= block, F.col("comp")))
    size = of.groupBy("key", "own").agg(F.ceil(F.sum("m") / F.lit(block)).cast("int").alias("parts"))
    number = Window.partitionBy("key").orderBy(F.col("own").asc_nulls_first(), "i")
    each = size.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).withColumn("part", F.row_number().over(number))
    other = each.select("key", F.col("own").alias("own2"), F.col("part").alias("part2"))
    apart = F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2"))
    met = each.join(other.hint("merge"), "key").where(F.when(F.col("part") == F.col("part2"), F.col("own").isNull()).otherwise(apart))
    met = met.select(F.col("key").alias("k"), F.col("own").alias("o"), F.col("i").alias("at"), "part", F.least("part", "part2").alias("low"), F.greatest("part", "part2").alias("high"))
    size = size.select(F.col("key").alias("k"), F.col("own").alias("o"), "parts")
    of = of.join(size.hint("merge"), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("o"))).select("key", "comp", "own", "parts")
    placed = rows.join(of.hint("merge"), ["key", "comp"]).withColumn("i", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
    many = placed.join(met.hint("merge"), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("o")) & (F.col("i") == F.col("at")))
    return few.unionByName(many.select(*members.columns, "low", "high", "part"))
