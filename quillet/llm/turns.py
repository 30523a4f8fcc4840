"""Conversation structure repair as a scan of min-plus matrices.

A well-formed conversation is an optional system turn and then user and assistant turns that take each other's place, the
last one an assistant's, or nothing at all. Four states follow what has been put out: nothing, a system turn, a user turn,
an assistant turn. Every turn is a 4x4 matrix over (cost, audit): the cheapest edits that lead from one state to another,
of equal costs the least string of their initials. Before it come insertions: each matrix is multiplied by the closure of
the insertion matrix. Products are associative, so turns of a conversation are multiplied as a tree: in partitions of the
order (conversation, turn) first, and what lies in several partitions by rounds of FAN partitions each. The same tree is
then walked down to tell each partition the states where the best path enters and leaves its part, from which its edits
follow. A conversation with any share of all rows spreads over as many partitions as its rows fill.

The audit of a conversation is one string of a byte a turn and is carried in the tree, so it bounds what a task holds, as
does a partition's rows of one conversation. Nothing goes to the driver but one boolean a round.

Of equal costs and different lengths neither audit begins with the other: both spend as many letters on turns, and each
insertion more costs more. So the least string stays least whatever follows, and (cost, audit) is a semiring on paths.

Odd input: a null role or text is one space, a null conv_id is a conversation of its own, null turns come first. Rows of
one turn stand by role and a hash of role and text. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import keyed, stage

WHITE = " \t\n\x0b\x0c\r"
#: What edits cost: role changes, deletions, insertions, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAN = 8
#: From a state, the state behind a turn of a role; states: nothing, system, user, assistant.
AFTER = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
NEXT_ROLE = ("user", "user", "assistant", "user")
END = (0, 3)
ONLY_DELETE = 8
CLASSES = "sua"

Matrix = tuple  # 16 of (cost, audit) or None, row by row
ONE: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def least(a, b):
    return b if a is None or (b is not None and b < a) else a


def times(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(4):
        row = [(k, x[4 * i + k]) for k in range(4) if x[4 * i + k] is not None]
        for j in range(4):
            best = None
            for k, a in row:
                b = y[4 * k + j]
                if b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = least(best, (a[0] + b[0], a[1] + b[1]))
            out.append(best)
    return tuple(out)


def plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(map(least, x, y))


def steps(*moves: tuple[dict, int, str]) -> Matrix:
    """The matrix of single edits: where they lead, cost, initial."""
    out = [None] * 16
    for to, cost, initial in moves:
        for i, j in to.items():
            out[4 * i + j] = least(out[4 * i + j], (cost, initial))
    return tuple(out)


_any_role = AFTER["u"] | AFTER["a"]
_insert = steps((_any_role, INSERT, "I"))
#: Any number of insertions; three or more lead nowhere that fewer don't.
CLOSURE = plus(plus(ONE, _insert), times(_insert, _insert))


@functools.cache
def of_turn(code: int) -> Matrix:
    """Insertions and then one turn. code: the class of its role (system, user, assistant, other), 4 more if truncated; or ONLY_DELETE."""
    gone = ({i: i for i in range(4)}, DELETE, "D")
    if code == ONLY_DELETE:
        return times(CLOSURE, steps(gone))
    extra = TRUNCATED if code & 4 else 0
    keep = AFTER[CLASSES[code & 3]] if code & 3 < 3 else {}
    return times(CLOSURE, steps(gone, (keep, extra, "K"), (_any_role, REROLE + extra, "R")))


@functools.lru_cache(20_000)
def of_few(codes: tuple[int, ...]) -> Matrix:
    return functools.reduce(times, map(of_turn, codes), ONE)


def product(matrices: list[Matrix]) -> Matrix:
    """The product of a list, as a tree, so that long audits are copied a logarithmic number of times."""
    while len(matrices) > 1:
        matrices = [times(*pair) if len(pair) > 1 else pair[0] for pair in itertools.batched(matrices, 2)]
    return matrices[0] if matrices else ONE


def of_turns(codes: list[int]) -> Matrix:
    return product([of_few(c) for c in itertools.batched(codes, 4)])


def best_path(m: Matrix) -> tuple[int, int, int, str]:
    """cost, the state before the last insertions, that behind them, and the audit, of a whole conversation's matrix."""
    found = None
    for k in range(4):
        for end in END:
            a, b = m[k], CLOSURE[4 * k + end]
            if a is not None and b is not None:
                found = least(found, (a[0] + b[0], a[1] + b[1], k, end))
    return found[0], found[2], found[3], found[1]


def edited(rows: list[tuple], state: int, audit: str) -> list[tuple]:
    """(edit, role, text) of each edit, given turns (role, text) and the state before them."""
    out, at = [], 0
    for e in audit:
        if e == "I":
            role, text = NEXT_ROLE[state], ""
        else:
            (role, text), at = rows[at], at + 1
            if e == "R":
                role = NEXT_ROLE[state]
        out.append((e, role, text))
        if e != "D":
            state = AFTER[role[0]][state]
    return out


# -- elements: what is known of a stretch of a conversation, and how two of them join ------------------

COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
ELEMENT = [*[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("distinct", pa.int64()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
ELEMENT_DDL = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, lo bigint, hi bigint, distinct bigint, costs array<int>, audits array<string>"
KEY = [("anon", pa.bool_()), ("conv", pa.int64())]
KEY_DDL = "anon boolean, conv bigint"
LEGAL = {"su", "ua", "au"}


def initial(role: str) -> str:
    return role[:1]


def element(turns: list[int | None], roles: list[str], codes: list[int], faults: list[int]) -> dict:
    """faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    initials = list(map(initial, roles))
    known = [t for t in turns if t is not None]
    m = of_turns(codes)
    return {
        "n": len(codes), "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
        "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(initials)), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        "lo": known[0] if known else None, "hi": known[-1] if known else None, "distinct": len(set(known)), **stored(m),
    }


def stored(m: Matrix) -> dict:
    return {"costs": [None if x is None else x[0] for x in m], "audits": [None if x is None else x[1] for x in m]}


def matrix(e: dict) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(e["costs"], e["audits"], strict=True))


def joined(elements: list[dict]) -> dict:
    """Neighbouring stretches as one."""
    out = {c: sum(e[c] for e in elements) for c in COUNTS}
    full = [e for e in elements if e["n"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in itertools.pairwise(full))
    known = [e for e in full if e["lo"] is not None]
    out["distinct"] = sum(e["distinct"] for e in known) - sum(a["hi"] == b["lo"] for a, b in itertools.pairwise(known))
    ends = {"first": full[0]["first"] if full else None, "last": full[-1]["last"] if full else None, "lo": known[0]["lo"] if known else None, "hi": known[-1]["hi"] if known else None}
    return out | ends | stored(product(list(map(matrix, elements))))


def result(e: dict) -> dict:
    """The figures of a whole conversation, and the states of its best path."""
    cost, before_last, end, audit = best_path(matrix(e))
    gaps = 0 if e["lo"] is None else e["hi"] - e["lo"] + 1 - e["distinct"]
    return {"gaps": gaps, **{c: e[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "leave": before_last, "end": end}


RESULT = [("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("leave", pa.int8()), ("end", pa.int8())]
TURN = [("part", pa.int32()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
SCHEMA = pa.schema([("kind", pa.int8()), *KEY, *TURN, *RESULT, *ELEMENT])
DDL = f"kind tinyint, {KEY_DDL}, part int, seq bigint, edit string, role string, text string, gaps bigint, cost bigint, audit string, leave tinyint, end tinyint, {ELEMENT_DDL}"
WHOLE, EDGE, WAITING, EDITED = range(4)
#: Rows and characters of texts after which a batch leaves.
BATCH_ROWS, BATCH_CHARS = 4096, 4_000_000


class Run:
    """The rows of one conversation in one partition."""

    def __init__(self, key: tuple):
        self.key, self.turns, self.roles, self.texts, self.codes, self.faults = key, [], [], [], [], []

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        at = CLASSES.find(initial(role)) if role else -1
        self.codes.append(ONLY_DELETE if fault in (1, 2) else (3 if at < 0 else at) + (4 if fault == 3 else 0))


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie within the partition are repaired; the first and the last one may go on outside and wait."""
    part, out, chars = TaskContext.get().partitionId(), [], 0

    def close(run: Run, edge: bool) -> None:
        nonlocal chars
        key = {"anon": run.key[0], "conv": run.key[1], "part": part}
        e = element(run.turns, run.roles, run.codes, run.faults)
        if edge:
            out.append({"kind": EDGE, **key, **e})
            out.extend({"kind": WAITING, **key, "seq": i, "role": r, "text": t} for i, (r, t) in enumerate(zip(run.roles, run.texts, strict=True)))
        else:
            r = result(e)
            out.append({"kind": WHOLE, **key, **r})
            out.extend({"kind": EDITED, **key, "seq": i, "edit": e, "role": role, "text": text} for i, (e, role, text) in enumerate(edited(list(zip(run.roles, run.texts, strict=True)), 0, r["audit"])))
        chars += sum(map(len, run.texts))

    run, first = None, True
    for batch in batches:
        for anon, conv, turn, role, text, there, fault in zip(*(batch.column(c).to_pylist() for c in ("anon", "conv", "turn", "role", "text", "there", "fault")), strict=True):
            if run is None or run.key != (anon, conv):
                if run is not None:
                    close(run, first)
                    first = False
                run = Run((anon, conv))
            if there:
                run.add(turn, role, text, fault)
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield packed(out)
                out.clear()
                chars = 0
    if run is not None:
        close(run, True)
    if out:
        yield packed(out)


# -- the operator ---------------------------------------------------------------------------------------


def with_faults(turns: DataFrame) -> DataFrame:
    """anon, conv, turn, role, text, there, fault, digest, rid of each turn: its first fault (1 blank, 2 duplicate, 3 truncated)."""
    has = "there" in turns.columns
    rows = keyed(turns, conv_id="conv_id", turn="turn", role="role", text="text", **({"there": "there"} if has else {}))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(
        "rid", F.col("conv_id").isNull().alias("anon"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        space("role"), space("text"), (F.coalesce("there", F.lit(True)) if has else F.lit(True)).alias("there"),
    )
    kept = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumns({"digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "blank": kept == "", "cut": ~F.right(kept, F.lit(1)).isin(".", "!", "?")})
    rows = stage(rows, "turns")
    place = F.struct("turn", "rid")
    firsts = rows.where("there and not blank").groupBy("anon", "conv", "digest").agg(F.count("*").alias("copies"), F.min(place).alias("first_place")).where("copies > 1")
    rows = rows.join(firsts.drop("copies"), ["anon", "conv", "digest"], "left")
    again = F.col("first_place").isNotNull() & ~place.eqNullSafe(F.col("first_place"))
    return rows.withColumn("fault", F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations, of turns (conv_id, turn, role, text; optional there: false for rows that only name a conversation).

    First frame, a row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Second, a
    row for each edit in the order (part, seq): conv_id, part, seq, edit, role, text; deleted turns have edit D.
    """
    spark = turns.sparkSession
    order = ["anon", "conv", "turn", "role", "digest", "rid"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = with_faults(turns).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stage(placed.mapInArrow(scan, DDL), "scanned", by="kind")
    of = lambda kind: found.where(F.col("kind") == kind)

    key, columns = ["anon", "conv"], [c for c, _ in ELEMENT]
    levels = [of(EDGE).select(*key, F.col("part").cast("bigint").alias("node"), *columns)]
    node_schema = pa.schema([*KEY, ("node", pa.int64()), *ELEMENT])

    def up(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["node"])
        return pa.Table.from_pylist([{"anon": rows[0]["anon"], "conv": rows[0]["conv"], "node": rows[0]["node"] // FAN, **joined(rows)}], schema=node_schema)

    while not levels[-1].where("node > 0").isEmpty():
        by = [*key, F.floor(F.col("node") / FAN)]
        levels.append(stage(levels[-1].groupBy(*by).applyInArrow(up, f"{KEY_DDL}, node bigint, {ELEMENT_DDL}"), "tree"))

    result_schema = pa.schema([*KEY, *[(c, pa.int64()) for c in COUNTS[1:]], *RESULT])
    result_ddl = f"{KEY_DDL}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint, cost bigint, audit string, leave tinyint, end tinyint"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"anon": row["anon"], "conv": row["conv"], **result(row)}], schema=result_schema)

    tops = stage(levels[-1].mapInArrow(ends, result_ddl), "tops")
    way = tops.select(*key, F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("tinyint").alias("enter"), "leave")
    way_schema, way_ddl = pa.schema([*KEY, ("node", pa.int64()), ("enter", pa.int8()), ("leave", pa.int8())]), f"{KEY_DDL}, node bigint, enter tinyint, leave tinyint"

    def down(parent: pa.Table, children: pa.Table) -> pa.Table:
        """Where the best path through a node enters and leaves its children."""
        if not parent.num_rows or not children.num_rows:
            return way_schema.empty_table()
        p, rows = parent.to_pylist()[0], sorted(children.to_pylist(), key=lambda r: r["node"])
        at = {p["enter"]: (0, "", ())}
        for r in rows:
            m, to = matrix(r), {}
            for i, (cost, audit, path) in at.items():
                for j in range(4):
                    x = m[4 * i + j]
                    if x is not None:
                        to[j] = least(to.get(j), (cost + x[0], audit + x[1], (*path, j)))
            at = to
        path = (p["enter"], *at[p["leave"]][2])
        return pa.Table.from_pylist([{"anon": r["anon"], "conv": r["conv"], "node": r["node"], "enter": a, "leave": b} for r, (a, b) in zip(rows, itertools.pairwise(path), strict=True)], schema=way_schema)

    for below in reversed(levels[:-1]):
        children = below.withColumn("up", F.floor(F.col("node") / FAN).cast("bigint"))
        way = stage(way.groupBy(*key, "node").cogroup(children.groupBy(*key, "up")).applyInArrow(down, way_ddl), "way")

    chosen = F.col("enter") * 4 + F.col("leave") + 1
    told = way.join(levels[0].select(*key, "node", "audits"), [*key, "node"]).select(*key, F.col("node").cast("int").alias("part"), "enter", F.element_at("audits", chosen).alias("audit"))
    turn_schema, turn_ddl = pa.schema([*KEY, *TURN]), f"{KEY_DDL}, part int, seq bigint, edit string, role string, text string"

    def edit(rows: pa.Table, way: pa.Table) -> pa.Table:
        if not way.num_rows:
            return turn_schema.empty_table()
        w = way.to_pylist()[0]
        rows = rows.sort_by("seq")
        own = list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True))
        return pa.Table.from_pylist([{"anon": w["anon"], "conv": w["conv"], "part": w["part"], "seq": i, "edit": e, "role": role, "text": text} for i, (e, role, text) in enumerate(edited(own, w["enter"], w["audit"]))], schema=turn_schema)

    waiting = of(WAITING).select(*key, "part", "seq", "role", "text")
    edges = waiting.groupBy(*key, "part").cogroup(told.groupBy(*key, "part")).applyInArrow(edit, turn_ddl)
    # the insertions behind the last turn: a user turn after an assistant's needs an assistant, and so on
    roles = F.array(*[F.lit(r) for r in NEXT_ROLE])
    tails = tops.where("leave <> end").select(
        *key, F.lit(2**31 - 1).alias("part"), F.explode(F.expr("case when leave <> 2 and end = 3 then array(0L, 1L) else array(0L) end")).alias("seq"), F.lit("I").alias("edit"), "leave",
    )
    tails = tails.select(*key, "part", "seq", "edit", F.when(F.col("seq") == 1, "assistant").otherwise(F.element_at(roles, F.col("leave") + 1)).alias("role"), F.lit("").alias("text"))
    all_turns = of(EDITED).select(*key, "part", "seq", "edit", "role", "text").unionByName(edges).unionByName(tails)
    figures = [*COUNTS[1:], "gaps", "cost", "audit"]
    wholes = of(WHOLE).select(*key, *figures).unionByName(tops.select(*key, *figures))
    conv_id = F.when(~F.col("anon"), F.col("conv")).alias("conv_id")
    return wholes.select(conv_id, "gaps", *COUNTS[1:], "cost", "audit"), all_turns.select(conv_id, "part", "seq", "edit", "role", "text")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the turns that stay, as role:text, newline-joined: one row holds a conversation's text."""
    line = F.struct("part", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = F.array_sort(F.collect_list(line))
    return turns.where("edit <> 'D'").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations, damaged by the crc32 of conv_id:turn modulo 20; dropped ones stay with there = false."""
    rows = keyed(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("what"))
    what = F.col("what")
    return rows.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(what == 0, F.array(F.lit(False))).when(what == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("there"),
    )
