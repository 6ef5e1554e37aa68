"""Repair of damaged conversations at least cost, by a backward table of costs to go and a forward walk.

A conversation's roles must spell (s?(ua)+)? by their initials. Each row is kept (0), reroled to user or assistant (3) or
deleted (4, the only choice for blank and duplicate rows), and empty turns of a user or assistant go in anywhere (3);
a truncated row that stays adds 3. The backward pass knows for each row and grammar state the least cost of the
rest; the forward walk takes the ASCII-least edit whose cost is tight, and the state fixes the role of a rerole or insert.

Equal rows of one turn travel as one with a count. Rows are dealt by range of (conversation, turn), so one conversation may
hold any share of them: it lies in segments, each of which is a 4 x 4 table of least costs from state to state; these are
put together from the end backward, then the states in which the walk enters each are passed on forward. Texts take no
part in this; they meet their edits in one pass over rows in order, for the hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import tidy
from .ordered import EMPTY, ordered_digests, tuples, written

SEGMENT = 10_000
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's; and the one that an insert or rerole leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
FAR = 1 << 60
#: Role initials s, u, a and any other; the state that keeping one leads to from each state.
KEEP = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None, None, None, None))
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}

Row = tuple[int, int, int]  # initial, fault of the first of equal rows, how many


def relaxed(v: list[int]) -> list[int]:
    """Costs to go with inserts allowed first."""
    v = list(v)
    u, a = v[USER], v[ASSISTANT]
    v[USER], v[ASSISTANT] = min(u, INSERT + a), min(a, INSERT + u)
    v[START], v[SYSTEM] = min(v[START], INSERT + v[USER]), min(v[SYSTEM], INSERT + v[USER])
    return v


ACCEPT = relaxed([0, FAR, FAR, 0])


def step(row: Row, after: list[int]) -> list[int]:
    """Costs to go before a row from those after it."""
    initial, fault, times = row
    if fault in (BLANK, DUPLICATE):
        return [min(FAR, c + DELETE * times) for c in after]
    more, cut = DELETE * (times - 1), CUT * (fault == TRUNCATED)
    out = []
    for q in range(4):
        best = min(DELETE + after[q], REROLE + cut + after[NEXT[q]])
        kept = KEEP[initial][q]
        out.append(min(FAR, more + (best if kept is None else min(best, cut + after[kept]))))
    return relaxed(out)


def costs(rows: list[Row], end: list[int]) -> list[list[int]]:
    """Costs to go before each row, and ``end``."""
    table = [end]
    for row in reversed(rows):
        table.append(step(row, table[-1]))
    table.reverse()
    return table


def walk(rows: list[Row], table: list[list[int]], state: int, last: bool) -> tuple[str, int, list[str], int]:
    """(edits, cost, what each row becomes, state at the end).

    What a row becomes is a line for each letter: u, a an empty turn, k the row itself, U, A the row reroled. ``last``: nothing
    follows, so that turns still missing go in at the end, with the last row.
    """
    audit, lines, q = [], [], state
    for i, (initial, fault, times) in enumerate(rows):
        after, line = table[i + 1], []
        if fault in (BLANK, DUPLICATE):
            audit.append("D" * times)
            lines.append("")
            continue
        more, cut = DELETE * (times - 1), CUT * (fault == TRUNCATED)
        while True:
            now = table[i][q]
            if DELETE + more + after[q] == now:
                audit.append("D")
            elif INSERT + table[i][NEXT[q]] == now:
                audit.append("I")
                q = NEXT[q]
                line.append("ua"[q == ASSISTANT])
                continue
            elif (kept := KEEP[initial][q]) is not None and more + cut + after[kept] == now:
                audit.append("K")
                q = kept
                line.append("k")
            else:
                audit.append("R")
                q = NEXT[q]
                line.append("UA"[q == ASSISTANT])
            break
        audit.append("D" * (times - 1))
        lines.append("".join(line))
    if last:
        while table[-1][q]:
            audit.append("I")
            q = NEXT[q]
            lines[-1] += "ua"[q == ASSISTANT]
    return "".join(audit), table[0][state] - table[-1][q] if not last else table[0][state], lines, q


def summary(rows: list[Row], turns: list[int | None]) -> tuple:
    """(first initial, last initial, least, greatest and number of turns, blank, duplicate, truncated, illegal) of consecutive rows."""
    blank = sum(n for _, f, n in rows if f == BLANK)
    duplicate = sum(n for _, f, n in rows if f == DUPLICATE) + sum(n - 1 for _, f, n in rows if f in (NONE, TRUNCATED))
    truncated = sum(f == TRUNCATED for _, f, _ in rows)
    illegal = sum(n - 1 for _, _, n in rows) + sum(not legal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))
    known = [t for t in turns if t is not None]
    return rows[0][0], rows[-1][0], min(known, default=None), max(known, default=None), len(set(known)), blank, duplicate, truncated, illegal


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


# the job -----------------------------------------------------------------------


def marked(turns: DataFrame) -> DataFrame:
    """``(conv, turn, digest, initial, fault, n)``: equal rows of a turn as one, with the fault of their first."""
    body = F.trim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    rows = turns.select("conv", "turn", digest().alias("digest"), initial.alias("initial"), fault.alias("fault"))
    rows = rows.groupBy("conv", "turn", "digest").agg(F.max("initial").alias("initial"), F.max("fault").alias("fault"), F.count("*").alias("n"))
    rows = materialize(rows, "marked")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    out = rows.join(first, rows["conv"].eqNullSafe(first["c"]) & (rows["digest"] == first["d"]), "left")
    again = F.col("first").isNotNull() & (F.col("first") != place) & (F.col("fault") != BLANK)
    return out.select("conv", "turn", "digest", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "n")


def digest():
    return F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, 16)


SEGMENT_COLUMNS = "part int, piece int, whole boolean, turns array<bigint>, digests array<binary>, initials array<int>, faults array<int>, times array<bigint>"
SOLVED_COLUMNS = "part int, piece int, audit string, cost bigint, low bigint, high bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns array<bigint>, digests array<binary>, becomes array<string>"


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Each conversation's rows in order, at most ``most`` in one; ``whole`` if it has no other."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out() -> Iterator[tuple]:
            now, piece, held, first = None, 0, [], True
            for row in tuples(batches):
                if held and row[0] != now:
                    yield (now, part, piece, not first and not piece, *map(list, zip(*held, strict=True)))
                    piece, held, first = 0, [], False
                now = row[0]
                if len(held) >= most:
                    yield (now, part, piece, False, *map(list, zip(*held, strict=True)))
                    piece, held = piece + 1, []
                held.append(row[1:])
            if held:  # the last of a part may go on in the next
                yield (now, part, piece, False, *map(list, zip(*held, strict=True)))

        yield from written(out(), schema, 200)

    schema = schema_of(rows, SEGMENT_COLUMNS)
    order = ["conv", "turn", "digest"]
    return rows.select(*order, "initial", "fault", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: str):
    from pyspark.sql.types import StructType

    return StructType([df.schema["conv"], *StructType.fromDDL(columns).fields])


def solved(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of SOLVED_COLUMNS from (conv, part, piece, turns, digests, initials, faults, times, end, state, last, illegal, twice).

    ``end``: costs to go after the segment; ``state``: in which the walk enters it; ``illegal`` and ``twice``: whether its first row
    follows illegally on the segment before, and has the turn of its last.
    """
    for conv, part, piece, turns, digests, initials, faults, times, end, state, last, illegal, twice in rows:
        items = list(zip(initials, faults, times, strict=True))
        audit, cost, lines, _ = walk(items, costs(items, end), state, last)
        _, _, low, high, distinct, blank, duplicate, truncated, bad = summary(items, turns)
        yield conv, part, piece, audit, cost, low, high, distinct - twice, blank, duplicate, truncated, bad + illegal, turns, digests, lines


def mapped(df: DataFrame, columns: str, job: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """The rows that ``job`` makes of those of each part, with the conversation and ``columns``."""
    schema = schema_of(df, columns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from written(job(tuples(batches)), schema, 200)

    return df.mapInArrow(run, schema)


def tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The least costs from state to state of each segment."""
    for conv, part, piece, _, _, initials, faults, times in rows:
        items = list(zip(initials, faults, times, strict=True))
        each = [costs(items, [0 if k == q else FAR for k in range(4)])[0] for q in range(4)]
        yield conv, part, piece, [each[q][p] for p in range(4) for q in range(4)]


def backward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Costs to go after each segment, the last segment of a conversation first."""
    now, v = None, ACCEPT
    for conv, part, piece, least in rows:
        if last := now != (conv,):
            now, v = (conv,), ACCEPT
        yield conv, part, piece, v, last
        v = [min(min(FAR, least[4 * p + q] + v[q]) for q in range(4)) for p in range(4)]


def ways(rows: Iterator[tuple]) -> Iterator[tuple]:
    """In which state the walk leaves each segment, by that in which it enters."""
    for conv, part, piece, turns, _, initials, faults, times, end, last in rows:
        items = list(zip(initials, faults, times, strict=True))
        table = costs(items, end)
        exits = [walk(items, table, q, last)[3] for q in range(4)]
        yield conv, part, piece, end, last, exits, initials[0], initials[-1], turns[0], turns[-1]


def forward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """In which state the walk enters each segment, and how it joins the one before."""
    now, state, initial, turn = None, START, None, None
    for conv, part, piece, end, last, exits, first, final, first_turn, final_turn in rows:
        if now != (conv,):
            now, state, initial, turn = (conv,), START, None, None
        yield conv, part, piece, end, state, last, int(initial is not None and not legal(initial, first)), int(turn is not None and turn == first_turn)
        state, initial, turn = exits[state], final, final_turn


def joined_segments(open_: DataFrame) -> DataFrame:
    """``(conv, part, piece, end, state, last, illegal, twice)`` for the segments of conversations that have several, or might."""
    key = ["conv", "part", "piece"]
    least = mapped(open_, "part int, piece int, least array<bigint>", tables)
    ends = mapped(least.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("piece")), "part int, piece int, end array<bigint>, last boolean", backward)
    both = null_safe(open_, ends, key).select(*[open_[c] for c in open_.columns], ends["end"], ends["last"])
    exits = mapped(both, "part int, piece int, end array<bigint>, last boolean, exits array<int>, first int, final int, first_turn bigint, final_turn bigint", ways)
    return mapped(exits.repartition("conv").sortWithinPartitions(*key), "part int, piece int, end array<bigint>, state int, last boolean, illegal int, twice int", forward)


def null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    cond = F.lit(True)
    for c in on:
        cond = cond & a[c].eqNullSafe(b[c])
    return a.join(b, cond, how)


def repair(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row for each of ``convs``.

    ``turns``: ``(conv, turn, role, text)``, roles and texts not null; ``convs``: ``(conv)``, distinct. Conversations and turns
    may be null (a null turn comes first, a null conversation is one like any other); rows of one turn are taken in the order of
    a digest of role and text, equal rows beside each other. A conversation without rows has zeros, an empty audit and
    the hash of nothing. ``gaps`` counts the numbers missing between the least and the greatest turn; each row counts for the
    first fault that it has of blank, duplicate of an earlier row, and truncated; ``illegal`` counts neighbours whose
    role initials are not su, ua or au. ``audit`` spells the edits (Delete, Insert, Keep, Rerole).
    """
    parts = materialize(segments(marked(turns)), "segments")
    whole, open_ = parts.where("whole").drop("whole"), parts.where("not whole").drop("whole")
    known = joined_segments(open_)
    fields = ["turns", "digests", "initials", "faults", "times"]
    accept = F.array(*[F.lit(c).cast("long") for c in ACCEPT])
    alone = whole.select("conv", "part", "piece", *fields, accept.alias("end"), F.lit(START).alias("state"), F.lit(True).alias("last"), F.lit(0).alias("illegal"), F.lit(0).alias("twice"))
    several = null_safe(open_, known, ["conv", "part", "piece"]).select(*[open_[c] for c in ("conv", "part", "piece", *fields)], *[known[c] for c in ("end", "state", "last", "illegal", "twice")])

    done = materialize(mapped(alone.unionByName(several), SOLVED_COLUMNS, solved), "solved")
    sums = [F.sum(c).alias(c) for c in ("cost", "distinct", "blank", "duplicate", "truncated", "illegal")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "audit"))), lambda s: s["audit"]), "")
    facts = done.groupBy("conv").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), audit.alias("audit"))
    hashes = repaired_hashes(done, turns)
    out = null_safe(null_safe(convs, facts, ["conv"], "left").drop(facts["conv"]), hashes, ["conv"], "left").drop(hashes["conv"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        F.col("conv").alias("conv_id"), zero(F.col("high") - F.col("low") + 1 - F.col("distinct")).alias("gaps"), *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )


def repaired_hashes(done: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of the repaired ``role:text`` lines: rows of text, each after the row that says what becomes of it."""
    one = F.explode(F.arrays_zip("turns", "digests", "becomes"))
    edits = done.select("conv", one.alias("e")).where("e.becomes != ''")
    edits = edits.select("conv", F.col("e.turns").alias("turn"), F.col("e.digests").alias("digest"), F.lit(0).alias("kind"), F.col("e.becomes").alias("role"), F.lit("").alias("text"))
    texts = turns.select("conv", "turn", digest().alias("digest"), F.lit(1).alias("kind"), "role", "text")

    def lines(rows: Iterator[tuple]) -> Iterator[tuple[tuple, bytes]]:
        due, place = "", None
        for conv, turn, digest_, kind, role, text in rows:
            if not kind:
                due, place = role, (conv, turn, digest_)
            elif place != (conv, turn, digest_):
                continue
            while due and (kind or due[0] in "ua"):
                c, due = due[0], due[1:]
                line = {"u": "user:", "a": "assistant:"}.get(c) or f"{role if c == 'k' else ROLE[USER] if c == 'U' else ROLE[ASSISTANT]}:{text}"
                yield (conv,), line.encode()
            if kind:
                place = None

    return ordered_digests(edits.unionByName(texts), ["conv"], ["turn", "digest"], lines, b"\n", after=("kind",))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)``: rows harmed by crc32 of ``conv_id:turn`` modulo 20 (0 drop, 1 empty, 2 no ends of sentences, 3 twice, 4 role user); nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("how")
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", word("role").alias("role"), word("text").alias("text"), how).where("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))
    return rows.select("conv", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
