"""Near-duplicates at a similarity: SimHash links, an exact check, and an exact way for what SimHash misses.

A link is a Jaccard similarity of 4/5 or more of the sets of word shingles. Candidates
come first from ``simhash``: fingerprints of the sets that are equal or linked over
anchors. Sets that alike differ in 10 of 64 fingerprint bits on average, more than any
covering of few anchors reaches, so the rest is found exactly: put all shingles in one
order; two alike sets share a shingle among the first ``n - ceil(4n/5) + 1`` of each. The
order puts shingles of many rows last and is by hash otherwise; it bears on the number of
candidates, never on the result.

Rows of equal sets are one class. The first round checks, besides SimHash's links, each
class against the PIVOTS with which it shares most shingles of the prefix, of those that are
the least of a shingle's group; further rounds do so with others of other connected parts, picked by chance, and with the one of each part that looks most
alike. Then, within a group of one shingle, all classes meet that are not connected yet. Sizes and
parity bitmaps rule out most pairs before whole sets are compared. Shingles are compared by 64 bits, made
of 128 bits of each word; sets are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, release, scratch
from . import simhash
from .common import BROADCAST_KEYS, U64, binary_array, buffers, keep_one, mixed, raw_text, slices, tidy, unused, with_key
from .substring import rolled, sent, unpacked, word_hashes

SHINGLE = 5
#: The least similarity of a link is NUM / DEN.
NUM, DEN = 4, 5
#: Rows that the order of shingles is first learnt from, and rows of these that make a shingle common; prefixes beyond which one is frequent.
SAMPLE_ROWS, COMMON, HOT = 20_000, 20, 8
#: Prefix entries that a task gathers before it sends them, and that a slice is to hold.
GATHER, SLICE_ENTRIES = 250_000, 1_000_000
#: Slices of the counts of shingles.
COUNT_SLICES = 256
#: Classes that each one is checked against in a round of pivots, and so many rounds at most, after the first one.
PIVOTS, ROUNDS = 2, 2
#: Rounds in which each class is checked against the one of each other part that differs from it in fewest bits.
NEAREST = 1
#: Classes of a group that one task compares with the whole of it.
GROUP_PART = 1000
#: Sets of fewer members are named by 128 bits of each.
SMALL = 10
#: Longs of the bitmap with which the join of the second round is made.
FOLDED = 16
#: Pairs that meet one copy of a set.
PAIRS_A_COPY = 256
SEED = 42
ASK, KNOWN = 0, 1


def shingled(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, bytes]]:
    """(sorted distinct hashes of the word shingles, 64 more bits of each) of each text; the latter only of sets below SMALL.

    A-Z lower-cased, words between ASCII white space; fewer words are one shingle. Larger sets that differ in one
    shingle are alike anyway, and those that differ in more must collide twice.
    """
    low = raw | (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    words, others, first = word_hashes(low, off)
    h, g = rolled(words, shingle), rolled(others, shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a - shingle + 1
        if n >= SMALL:
            own = np.unique(h[a : a + n])
            more = b""
            if len(own) < SMALL:
                own, at = np.unique(h[a : a + n], return_index=True)
                more = g[a : a + n][at].tobytes()
            yield own, more
        elif n > 0:
            own, at = np.unique(h[a : a + n], return_index=True)
            yield own, g[a : a + n][at].tobytes()
        elif b > a:
            yield mixed(rolled(words[a:b], b - a)[:1] + U64(b - a)), rolled(others[a:b], b - a)[:1].tobytes()
        else:
            yield np.zeros(0, U64), b""


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    return [s for s, _ in shingled(raw, off, shingle)]


def sets_in(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, bytes]]:
    raw, off = buffers(column)
    for a, b in slices(off):
        yield from shingled(raw[off[a] : off[b]], off[a : b + 1] - off[a], shingle)


#: Names of sets that two different ones share, so that the second half of their digest must tell them apart.
Clashes = frozenset[int]


def names_of(hashes: np.ndarray, more: bytes) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    digest = hashlib.blake2b(hashes.tobytes() + more, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def class_of(hashes: np.ndarray, more: bytes, clashes: Clashes = frozenset()) -> int:
    """A set's class: the first half of its name, or the second where the first is shared."""
    name, second = names_of(hashes, more)
    return second if name in clashes else name


def class_of_text(text: bytes, shingle: int = SHINGLE, clashes: Clashes = frozenset()) -> int:
    return class_of(*next(shingled(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle)), clashes)


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the hashes by their last bits, in longs: two sets differ in at least as many members as these in bits."""
    odd = np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities in at least as many bits as the set has members, so that it tells large sets apart as well as small ones."""
    return parities(hashes, 1 << max(6, (len(hashes) - 1).bit_length()))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first codes of a set in order: the rank of a common shingle in the top byte, its hash below."""
    n = len(hashes)
    if not n:
        return hashes
    size = n - -(-NUM * n // DEN) + 1
    codes = hashes >> U64(8)
    if len(common):
        j = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        known = np.flatnonzero(common[j] == codes)
        if len(known):
            codes[known] |= rank[j[known]] << U64(56)
            return np.sort(codes)[:size]
    return codes[:size]


def lists(values: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def blobs(values: list[np.ndarray]) -> pa.Array:
    data = np.concatenate([v.view(np.uint8) for v in values]) if values else np.zeros(0, np.uint8)
    return binary_array(data, np.cumsum([v.nbytes for v in values]))


Order = tuple[np.ndarray, np.ndarray]


def order_of(codes: np.ndarray, times: np.ndarray) -> Order:
    """Common codes, sorted, with their ranks: the more rows, the later."""
    at = np.argsort(codes, kind="stable")
    codes, rank = codes[at], np.clip(8 * np.log2(times[at]), 1, 127).astype(U64)
    last = np.append(codes[1:] != codes[:-1], True) if len(codes) else np.zeros(0, bool)
    return codes[last], rank[last]


def sampled(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows) of the shingles in at least COMMON rows of a bounded sample; rows are scaled up to the table."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(0))
            for a, b in slices(off):
                h, n = np.unique(np.concatenate(shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], shingle)) >> U64(8), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    some = docs.select(raw_text(text)).sample(share, SEED) if share < 1 else docs.select(raw_text(text))
    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "h").limit(BROADCAST_KEYS).toArrow()
    return got.column(0).to_numpy().view(U64), got.column(1).to_numpy() / share


def counted(docs: DataFrame, text: str, shingle: int, known: Order) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows) of shingles in more than HOT prefixes under the order ``known``: the BROADCAST_KEYS most frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def flush(hs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(hs), return_counts=True)
        yield from sent((mixed(h) % U64(COUNT_SLICES)).astype(np.int64), [h, np.minimum(n, 0xFFFF).astype(np.uint16)], ASK)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, size = [], 0
        for batch in batches:
            for s, _ in sets_in(batch.column(0), shingle):
                hs.append(prefix(s, *shared.value))
                size += len(hs[-1])
                if size >= GATHER:
                    yield from flush(hs)
                    hs, size = [], 0
        if size:
            yield from flush(hs)

    def total(table: pa.Table) -> pa.Table:
        h, n = (np.concatenate(c) for c in zip(*(unpacked(x, "<u8", "<u2") for x in table.column("data").to_pylist()), strict=True))
        h, of = np.unique(h, return_inverse=True)
        n = np.bincount(of, n).astype(np.int64)
        return pa.table({"h": pa.array(h[n > HOT].view(np.int64)), "n": pa.array(n[n > HOT])})

    counts = docs.select(raw_text(text)).mapInArrow(run, "slice int, kind int, data binary").groupBy("slice").applyInArrow(total, "h long, n long")
    got = counts.orderBy(F.desc("n"), "h").limit(BROADCAST_KEYS).toArrow()
    return got.column(0).to_numpy().view(U64) & U64((1 << 56) - 1), got.column(1).to_numpy()


def learnt_order(docs: DataFrame, text: str, shingle: int) -> Order:
    """Shingles of many rows come last: those common in a sample, and what is still frequent in the prefixes then."""
    codes, times = sampled(docs, text, shingle)
    more, more_times = counted(docs, text, shingle, order_of(codes, times))
    return order_of(np.concatenate([codes, more]), np.concatenate([times, more_times]))


def profiles(docs: DataFrame, doc: str, text: str, shingle: int) -> DataFrame:
    """``(doc, key, second, n, fp, f0 ..., bits, head)``: name, size, SimHash fingerprint, bitmaps and prefix of each row's set."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt_order(docs, text, shingle))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(*names_of(s, more), len(s), simhash.majority(s), parities(s, 64 * FOLDED), bitmap(s), prefix(s, *shared.value)) for s, more in sets_in(batch.column(1), shingle)]
            key, second, n, fp, few, bits, head = zip(*done, strict=True) if done else ((),) * 7
            folded = np.array(few, np.int64).reshape(-1, FOLDED)
            cols = [batch.column(0), pa.array(key, pa.int64()), pa.array(second, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fp, U64).view(np.int64)), *(pa.array(folded[:, i]) for i in range(FOLDED)), blobs([*bits]), lists([*head])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "key", "second", "n", "fp", *(f"f{i}" for i in range(FOLDED)), "bits", "head"])

    kind = docs.schema[doc].dataType.simpleString()
    words = ", ".join(f"f{i} long" for i in range(FOLDED))
    return docs.select(F.col(doc).alias("doc"), raw_text(text)).mapInArrow(run, f"doc {kind}, key long, second long, n long, fp long, {words}, bits binary, head array<long>")


def told_apart(rows: DataFrame) -> tuple[DataFrame, Clashes]:
    """``rows`` with the class as ``key``, and the names that different sets share: some n^2 / 2^65 of n sets."""
    two = rows.groupBy("key").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi")
    clashes = frozenset(r["key"] for r in two.select("key").collect())
    key = F.when(F.col("key").isin(*clashes), F.col("second")).otherwise(F.col("key")) if clashes else F.col("key")
    return rows.withColumn("key", key).drop("second"), clashes


def live_prefixes(rows: DataFrame) -> DataFrame:
    """``(h, key)`` of the prefix entries whose shingle is in the prefix of another class too.

    A task settles shingles that repeat in its own rows and asks once for each shingle, so a
    shingle of any number of rows is spread over all tasks.
    """
    total = rows.agg(F.sum(F.size("head"))).first()[0] or 0
    n_slices = U64(max(64, -(-total // SLICE_ENTRIES)))

    def flush(hs: list[np.ndarray], ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, k = np.concatenate(hs), np.concatenate(ks)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.append(True, h[1:] != h[:-1])
        once = new | np.append(True, k[1:] != k[:-1])
        h, k, new = h[once], k[once], new[once]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        yield from sent((mixed(h[first]) % n_slices).astype(np.int64), [h[first], k[first], np.minimum(n, 2).astype(np.uint8)], ASK)
        again = np.repeat(n > 1, n)
        yield from sent((mixed(k[again].view(U64)) % n_slices).astype(np.int64), [h[again], k[again]], KNOWN)

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ks, size = [], [], 0
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            hs.append(batch.column(1).flatten().to_numpy().view(U64))
            ks.append(np.repeat(batch.column(0).to_numpy(), n))
            size += len(hs[-1])
            if size >= GATHER:
                yield from flush(hs, ks)
                hs, ks, size = [], [], 0
        if size:
            yield from flush(hs, ks)

    def answer(table: pa.Table) -> pa.Table:
        asked, h, k = [], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == KNOWN:
                x, y = unpacked(blob, "<u8", "<i8")
                h.append(x)
                k.append(y)
            else:
                asked.append(unpacked(blob, "<u8", "<i8", "u1"))
        if asked:
            x, y, n = (np.concatenate(c) for c in zip(*asked, strict=True))
            order = np.lexsort((y, x))
            x, y, n = x[order], y[order], n[order]
            run = np.cumsum(np.append(True, x[1:] != x[:-1])) - 1
            start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            end = np.append(start[1:], len(x)) - 1
            several = (y[start] != y[end]) | (np.maximum.reduceat(n, start) > 1)
            h.append(x[several[run]])
            k.append(y[several[run]])
        return pa.table({"h": pa.array(np.concatenate(h).view(np.int64)), "key": pa.array(np.concatenate(k))})

    asked = rows.select("key", "head").mapInArrow(ask, "slice int, kind int, data binary")
    return materialize(asked.groupBy("slice").applyInArrow(answer, "h long, key long").distinct(), "near-live")


def fits(n: str, m: str) -> Column:
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def differing() -> Column:
    """In how many bits small bitmaps differ."""
    return sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"f{i}_"))) for i in range(FOLDED)), F.lit(0))


def may_agree() -> Column:
    """False if small bitmaps differ in more bits than sets may in members: of n and m, (n + m) (1 - s) / (1 + s) at most."""
    return (NUM + DEN) * differing() <= (DEN - NUM) * (F.col("n") + F.col("n_"))


def may_be_alike(p: np.ndarray, q: np.ndarray, n: int, m: int) -> bool:
    """The same of whole bitmaps; the longer one is folded to the size of the shorter."""
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return (NUM + DEN) * int(np.bitwise_count(p ^ q).sum()) <= (DEN - NUM) * (n + m)


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least NUM / DEN."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return DEN * both >= NUM * (len(p) + len(q) - both)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and bitmaps do not rule out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i) for i in range(2, 6))
            ok = [may_be_alike(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64), n[i].as_py(), m[i].as_py()) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, end: classes.select(F.col("key").alias(k), F.col("n").alias("n" + end), F.col("bits").alias("bits" + end))
    full = pairs.join(side("a", ""), "a").join(side("b", "_"), "b").where(fits("n", "n_"))
    return materialize(full.select("a", "b", "n", "n_", "bits", "bits_").mapInArrow(run, "a long, b long"), "near-pairs")


def sets_of(docs: DataFrame, doc: str, text: str, rows: DataFrame, wanted: DataFrame, shingle: int, clashes: Clashes = frozenset()) -> DataFrame:
    """``(key, members)`` of the classes in ``wanted``, worked out again rather than kept for all, from the texts of one id for each class."""
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()) if few else None)
    name = unused(docs, "__of")
    ids = materialize(rows.join(F.broadcast(wanted) if few else wanted, "key").groupBy("key").agg(F.min("doc").alias(name)).select(name).distinct(), "near-ids")
    held = docs.join(F.broadcast(ids) if few else ids, docs[doc].eqNullSafe(ids[name]), "left_semi")  # no more ids than classes

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            raw, off = buffers(batch.column(0))
            for a, b in slices(off):
                sets = [(class_of(s, more, clashes), s) for s, more in shingled(raw[off[a] : off[b]], off[a : b + 1] - off[a], shingle)]
                if asked is not None:
                    at = np.searchsorted(asked, np.array([k for k, _ in sets], np.int64))
                    sets = [x for x, i in zip(sets, at.tolist(), strict=True) if i < len(asked) and asked[i] == x[0]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), blobs([s for _, s in sets])], names=["key", "members"])

    out = held.select(raw_text(text)).mapInArrow(run, "key long, members binary")
    out = out if few else out.join(wanted, "key", "left_semi")
    out = materialize(out.dropDuplicates(["key"]), "near-sets")
    release(ids)
    return out


def verified(docs: DataFrame, doc: str, text: str, rows: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, clashes: Clashes = frozenset()) -> DataFrame:
    """The pairs ``(a, b)`` whose Jaccard similarity is at least NUM / DEN.

    The set of ``b`` meets the pair; that of ``a``, which may be in any number of pairs, is
    sent in one copy for each PAIRS_A_COPY of them.
    """
    some = likely(pairs, classes)
    times = materialize(some.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).alias("copies")), "near-copies")
    ends = materialize(some.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-wanted")
    sets = sets_of(docs, doc, text, rows, ends, shingle, clashes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [alike(np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64)) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = sets.join(times.withColumnRenamed("a", "key"), "key").select(F.col("key").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("members").alias("x"))
    right = some.join(times, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies"))).join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    out = materialize(right.join(left, ["a", "copy"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")
    release(some, times, ends, sets)
    return out


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of classes of equal fingerprints, each with the least, and of the least ones of linked fingerprints."""
    prints = materialize(rows.groupBy("fp").agg(F.min("key").alias("rep")), "near-prints")
    equal = rows.join(prints, "fp").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    side = lambda c, k: prints.select(F.col("fp").alias(c), F.col("rep").alias(k))
    linked = simhash.links(prints).join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b")
    return equal.unionByName(linked)


def grouped_by_parts(live: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """``(h, key, n, part, size)`` of the groups that are in several parts; a group of two classes is settled by their pair alone."""
    parts = live.join(classes.select("key", "n"), "key").join(comp, "key", "left").select("h", "key", "n", F.coalesce("part", "key").alias("part"))
    several = parts.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("h", "size")
    return materialize(parts.join(several, "h"), "near-several")


def merged_parts(rows: DataFrame, comp: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``comp`` after the links ``new`` between classes of ``rows``: only parts are joined up, not classes."""
    part_of = rows.select("key", "part").distinct()
    ends = new.join(part_of.withColumnsRenamed({"key": "a", "part": "p"}), "a").join(part_of.withColumnsRenamed({"key": "b", "part": "q"}), "b").select("p", "q")
    to = materialize(connected_components(ends, "p", "q").withColumnsRenamed({"id": "part", "component": "to"}), "near-to")
    # parts of one class are in no list yet
    every = part_of.unionByName(comp.select("key", "part")).distinct()
    comp = materialize(every.join(to, "part", "left").select("key", F.coalesce("to", "part").alias("part")), "near-parts")
    rows = rows.drop("size").join(to, "part", "left").select("h", "key", "n", F.coalesce("to", "part").alias("part"))
    several = rows.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("h", "size")
    return materialize(rows.join(several, "h"), "near-several"), comp


def pivots(rows: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``, not ``tried``: each class with the PIVOTS of other parts with which it shares most groups, of those that chance picks in a ``turn``.

    A group is a shingle and a band of sizes, since alike sets are of like size; bands move by half their width from turn to turn.
    """
    band = F.floor(F.log("n") / math.log(DEN / NUM) + (turn % 2) / 2).alias("band")
    rows = rows.select("h", band, "key", "part")
    rank = F.struct(F.xxhash64("key", F.lit(turn)).alias("r"), "key", "part")
    one = rows.groupBy("h", "band").agg(F.min(rank).alias("one"))
    two = rows.join(one, ["h", "band"]).where(F.col("part") != F.col("one.part")).groupBy("h", "band").agg(F.min(rank)["key"].alias("two"))
    met = rows.join(one, ["h", "band"]).join(two, ["h", "band"]).select(F.when(F.col("part") != F.col("one.part"), F.col("one.key")).otherwise(F.col("two")).alias("pivot"), "key")
    shared = met.groupBy("pivot", "key").agg(F.count("*").alias("shared")).withColumns({"a": F.least("pivot", "key"), "b": F.greatest("pivot", "key")})
    new = shared.join(tried, ["a", "b"], "left_anti")
    best = new.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("shared"), "pivot"))).where(F.col("k") <= PIVOTS)
    return best.select("a", "b").distinct()


def meeting(left: DataFrame, classes: DataFrame) -> DataFrame:
    """``(a, b, part_, differ)``: classes of one group that are in different parts and may be alike; ``part_`` is that of b."""
    deals = left.withColumn("deals", F.expr(f"size div {GROUP_PART} + 1")).drop("size", "n").withColumn("before", F.lag("h").over(W.partitionBy("key").orderBy("h")))
    opened = materialize(deals.join(classes.drop("bits"), "key"), "near-open")
    # a large group is dealt over as many tasks as it has parts; each part meets the whole group
    right = opened.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"{c}_") for c in opened.columns if c not in ("h", "deals")])
    one = opened.withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals"))).drop("deals")
    # what shares the open shingle before, too, has met there
    met = F.coalesce(F.col("before") == F.col("before_"), F.lit(False))
    may = (F.col("key") < F.col("key_")) & (F.col("part") != F.col("part_")) & ~met & fits("n", "n_") & may_agree()
    return one.join(right, ["h", "deal"]).where(may).select(F.col("key").alias("a"), F.col("key_").alias("b"), "part_", differing().alias("differ"))


def links(docs: DataFrame, doc: str, text: str, rows: DataFrame, shingle: int = SHINGLE, clashes: Clashes = frozenset()) -> DataFrame:
    """``(a, b)`` links between classes; with their chains, all of similarity NUM / DEN or more."""
    live = live_prefixes(rows)
    classes = materialize(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", *(f"f{i}" for i in range(FOLDED)), "bits")]), "near-classes")
    least = materialize(live.groupBy("h").agg(F.min("key").alias("a")), "near-least")
    stars = materialize(live.join(least, "h").where("key <> a").groupBy("a", F.col("key").alias("b")).agg(F.count("*").alias("shared")), "near-stars")
    best = stars.withColumn("k", F.row_number().over(W.partitionBy("b").orderBy(F.desc("shared"), "a"))).where(F.col("k") <= PIVOTS).select("a", "b")
    check = lambda pairs: verified(docs, doc, text, rows, classes, pairs, shingle, clashes)
    tried = materialize(ordered(best.unionByName(fingerprint_pairs(rows))), "near-tried")
    found = check(tried)
    comp = materialize(connected_components(found, "a", "b").withColumnsRenamed({"id": "key", "component": "part"}), "near-parts")
    left = grouped_by_parts(live, classes, comp)
    for turn in range(ROUNDS + NEAREST):
        # what is alike joins up by pivots of other parts, then by what looks most alike in each, before all of a group meet
        if turn < ROUNDS:
            more = materialize(pivots(left, tried, turn), "near-pivots")
        else:
            near = meeting(left, classes).join(tried, ["a", "b"], "left_anti")
            more = materialize(ordered(near.groupBy("a", "part_").agg(F.min(F.struct("differ", "b"))["b"].alias("b"))), "near-nearest")
        if more.isEmpty():
            continue
        new = check(more)
        tried = materialize(tried.unionByName(more), "near-tried")
        if not new.isEmpty():
            found = materialize(found.unionByName(new), "near-links")
            left, comp = merged_parts(left, comp, new)
    more = meeting(left, classes).select("a", "b").distinct()
    of = lambda k: comp.select(F.col("key").alias(k), F.col("part").alias(f"part_{k}"))
    apart = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    more = materialize(more.unionByName(ordered(apart)).distinct().join(tried, ["a", "b"], "left_anti"), "near-more")
    out = found.unionByName(check(more))
    release(live, least, stars, tried, comp, left, more, classes)
    return out


def grouped(docs: DataFrame, doc: str, text: str, shingle: int) -> tuple[DataFrame, Clashes]:
    with scratch() as tables:
        rows, clashes = told_apart(materialize(profiles(docs, doc, text, shingle), "near-profiles"))
        found = links(docs, doc, text, rows, shingle, clashes)
        comp = connected_components(found, "a", "b").withColumnsRenamed({"id": "key", "component": "root"})
        out = materialize(rows.select("doc", "key").join(comp, "key", "left").select("doc", "key", F.coalesce("root", "key").alias("root")), "near-roots")
        tables.remove(out)
    return out, clashes


def near_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc, key, root)``, one row for each row of ``docs``; rows of one ``root`` are linked, directly or by others.

    Null and empty texts have the empty set and are linked to each other alone; texts of
    fewer words than a shingle are one shingle; very long texts are looked at whole; ids may
    be null or repeated and repeated rows fall together; other columns are not looked at; an
    empty table gives no rows.
    """
    return grouped(docs, doc, text, shingle)[0]


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the row of least id of each component, all columns as they are; null ids come last, ids may repeat."""
    rows, clashes = grouped(docs, doc, text, shingle)
    return keep_one(docs, rows, doc, text, lambda d: with_key(d, text, lambda t: class_of_text(t, shingle, clashes)))
