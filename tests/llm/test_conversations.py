"""The conversation trie and the repair of conversations against brute-force versions."""

import collections
import functools
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sentrail.llm import ordered, queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def key_digest(role, text, n=None):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:n]


def by_turn(rows, n=None):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key_digest(r[1], r[2], n)))


def table(spark, sf_dir, rows, name="conversations"):
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("conv", F.lit(1)).write.parquet(f"{sf_dir}/{name}.parquet")
    return str(sf_dir)


def awkward_rows(seed, n=40, longest=12):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "u2"], ["Yes.", "no", "  ", "", None, "Hm? ", "a!b", "long " * 500, "ß日.", "tail.\n"]
    rows = []
    for c in rng.sample(range(-20, 90), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:5] + [(None, 0, "user", "no id"), (None, 3, "assistant", "none.")]


# the trie --------------------------------------------------------------------


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t, r or "", x or ""))
    turns = {c: [r[1:] for r in by_turn(v)] for c, v in turns.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        path = tuple(turns.get(c - base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        yield p
        for k in kids[p]:
            yield from under(k)

    out = set()
    for p, m in members.items():
        sub = list(under(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), saved, sha(",".join(map(str, sorted(ends[p]))))))
    return out


def trie_rows(spark, sf_dir):
    got = [tuple(r) for r in queries.op12_prefix_trie(spark, sf_dir).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, tmp_path, seed):
    rows = awkward_rows(seed)
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) if seed == 2 else rows
    assert trie_rows(spark, table(spark, tmp_path, rows)) == plain_trie(rows)


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert trie_rows(spark, sf) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_copies(spark, tmp_path):
    rows = [(10, t, "user", f"t{t % 3}") for t in range(400)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(2)]
    assert trie_rows(spark, table(spark, tmp_path, rows)) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert trie_rows(spark, table(spark, tmp_path, [])) == set()
    assert trie_rows(spark, table(spark, tmp_path / "b", [(None, 1, "user", "x")])) == set()


# hashes ----------------------------------------------------------------------


def test_digests_of_pieces():
    lines = [(("a",), b"x" * 20), (("b",), b"1"), (("b",), b"2"), (("c",), b"y" * ordered.PIECE), (("c",), b"z"), (("c",), b"w"), (("d",), b"q")]
    got = list(ordered.pieces(iter(lines), b","))
    assert [(k[0], whole) for k, _, whole, _ in got] == [("a", False), ("b", True), ("c", False), ("c", False), ("d", False)]
    assert got[1][3] == hashlib.sha256(b"1,2").digest()
    assert b",".join(p[3] for p in got[2:4]) == b"y" * ordered.PIECE + b",z,w"


def test_ordered_digests_of_a_key_in_many_parts(spark):
    rows = spark.range(0, 3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id")
    got = ordered.ordered_digests(rows, ["k"], ["id"], lambda rs: (((k,), str(i).encode()) for k, i in rs), b",")
    got = dict(map(tuple, got.collect()))
    assert len(got) == 501 and got[0] == sha(",".join(map(str, range(2500)))) and got[2700] == sha("2700")


# the repair ------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = collections.defaultdict(list)
    for c, t, r, x in rows:
        space = [" " if v is None else str(v) for v in (c, t, r, x)]
        how, role, text = zlib.crc32(f"{space[0]}:{space[1]}".encode()) % 20, space[2], space[3]
        out[c]
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out[c] += [(t, role, text)] * (2 if how == 3 else 1)
    return {c: by_turn(v, 16) for c, v in out.items()}


def plain_repair(rows):
    """Least (cost, edits) by shortest path over (row, initials' state), the state found from the grammar itself."""
    faults, seen = [], set()
    for _, r, x in rows:
        body = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    fits = lambda s: any(GRAMMAR.fullmatch(s + t) for t in ("", "a", "ua"))
    short = lambda s: s if len(s) < 4 else s[:1].replace("u", "") + ("ua" if s[-1] == "a" else "uau")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if (i, short(s)) in done:
            continue
        if i == len(rows) and GRAMMAR.fullmatch(s):
            break
        done.add((i, short(s)))
        moves = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            moves.append((4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                moves.append((more, "K", i + 1, role[:1] or "?", (f"{role}:{text}",)))
                moves += [(3 + more, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, e, j, add, line in moves:
            if fits(s + add):
                heapq.heappush(heap, (cost + c, audit + e, j, s + add, lines + line))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    count = collections.Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))


def repaired(spark, sf_dir):
    got = [tuple(r) for r in queries.op13_repair(spark, sf_dir).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repair_equals_brute_force(spark, tmp_path, seed):
    rows = awkward_rows(seed, 60, 9)
    assert repaired(spark, table(spark, tmp_path, rows)) == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


def test_repair_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert repaired(spark, sf) == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


def test_repair_of_nothing(spark, tmp_path):
    assert repaired(spark, table(spark, tmp_path, [])) == {}
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert repaired(spark, table(spark, tmp_path / "b", [(1, gone, "user", "x")])) == {1: (0, 0, 0, 0, 0, 0, "", sha(""))}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_repair_in_segments(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    rows = [(c, t if rng.random() < 0.8 else t // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "no", "", f"t{t}.", f"u{t}"])) for c, n in ((1, 30), (2, 3), (3, 14), (4, 1)) for t in range(n)]
    monkeypatch.setattr(repair, "segments", functools.partial(repair.segments, most=size))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many parts as may be
    try:
        got = repaired(spark, table(spark, tmp_path, rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


def test_segments_put_together_equal_one_table():
    """Tables from state to state, and states passed on, against one table over all rows."""
    rng = random.Random(0)
    for _ in range(200):
        rows = [(rng.randrange(4), rng.choice([0, 0, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 12))]
        whole = repair.costs(rows, repair.ACCEPT)
        audit = repair.walk(rows, whole, repair.START, True)[0]
        cuts = sorted({0, *[rng.randrange(len(rows)) for _ in range(3)]})
        parts = [rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
        segs = [(1, 0, k, [None] * len(p), [], *map(list, zip(*p, strict=True))) for k, p in enumerate(parts)]
        ends = {r[2]: r for r in repair.backward(iter(sorted(repair.tables(iter(segs)), key=lambda r: -r[2])))}
        ways = list(repair.ways((*s, *ends[s[2]][3:]) for s in segs))
        known = {r[2]: r[3:] for r in repair.forward(iter(ways))}
        done = list(repair.solved((*s, *known[s[2]]) for s in segs))
        assert "".join(r[3] for r in done) == audit and sum(r[4] for r in done) == whole[0][repair.START]


def test_equal_rows_of_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "Same.")] * 30 + [(1, 1, "assistant", "Yes.")] * 2 + [(2, None, "user", "")] * 3
    assert repaired(spark, table(spark, tmp_path, rows)) == {c: plain_repair(v) for c, v in plain_damage(rows).items()}
