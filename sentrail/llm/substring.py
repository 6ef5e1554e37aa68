"""Repeated passages by level-wise doubling of word windows.

Level 1 looks at windows of half the wanted length, and of them only at those that
are the least, by hash, within some window of full length; equal full windows have
equal least halves, so nothing repeated is lost, and most of the text is never sent
anywhere. Only full windows whose half is repeated somewhere go on to level 2, of
twice the length, where the earliest place of each is found; ``longest`` doubles on
until no window survives.

Windows travel packed: each task sorts what it has into slices by the half's hash,
one binary value for each slice, after it has settled repeats of its own; so a
passage that millions of documents share costs each task one entry. A slice answers
by document. The answers meet the texts, which are shuffled by document once and
read twice. Everything is one lazy plan without files of its own: lost executors
cost a recomputation of what they held.

Hashes of full windows have 128 bits, made of 128 bits of each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..session import materialize
from .common import U64, binary_array, buffers, mixed, slices, tidy

WORDS = 20
#: Window entries that a task gathers before it sends them.
GATHER = 500_000
#: Text bytes whose windows one slice is to hold, and the least number of slices.
SLICE_BYTES, LEAST_SLICES = 12 << 20, 64
BASE = U64(0x9E3779B97F4A7C15)
#: Of the rounds that name a word, and the words that are named without a digest.
ROUNDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0), U64(0x082EFA98EC4E6C89))
SHORT = 16
#: Null ids are worked on as the greatest id, with ranks from here on.
NO_ID, NO_RANK = (1 << 63) - 1, 1 << 30


def word_places(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte of each word; number of words before each text) of texts end to end."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True  # a text starts or ends here
    inside = ~space
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def named_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word: those of the word itself up to SHORT bytes, stirred so that no two words of one length share them, else a digest."""
    size = (ends - starts).astype(U64)
    padded = np.concatenate([raw, np.zeros(SHORT, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # eight bytes from each byte on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    a = at[starts] & masks[np.minimum(size, U64(8)).astype(np.int64)]
    b = at[np.minimum(starts + 8, len(at) - 1)] & masks[np.clip(ends - starts - 8, 0, 8)]
    for k in ROUNDS:  # each can be undone, so different words stay different
        a, b = b, a ^ mixed(b + k + size)
    view = memoryview(raw)
    for i in np.flatnonzero(size > U64(SHORT)).tolist():
        a[i], b[i] = np.frombuffer(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
    return a, b


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits, 64 more of each word; number of words before each text) of texts end to end."""
    raw = np.ascontiguousarray(raw)
    starts, ends, first = word_places(raw, off)
    return (*named_words(raw, starts, ends), first)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from each position."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, done, part, width = None, 0, h, 1
    while width <= n:
        if n & width:
            piece = part[done : done + len(h) - n + 1]
            out = piece if out is None else mixed(out * BASE + piece)
            done += width
        if width * 2 <= n:
            part = mixed(part[:-width] * BASE + part[width:])
        width *= 2
    return out


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position."""
    width = 1
    out = h
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - width : n - width + len(h) - n + 1]) if len(h) >= n else np.zeros(0, U64)


class Windows:
    """The full windows of some texts: hashes, the least half of each, and their places."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, words: int):
        self.words, self.others, self.first = word_hashes(raw, off)
        half = words // 2
        n = len(self.words) - words + 1
        if n <= 0:
            self.at = np.zeros(0, np.int64)
            return
        halves = rolled(self.words, half)
        minimum = least(halves, words - half + 1)
        row = np.searchsorted(self.first, np.arange(n), side="right") - 1
        self.at = np.flatnonzero(np.arange(n) + words <= self.first[row + 1])  # windows within one text
        self.row = row[self.at]
        self.place = self.at - self.first[self.row]
        self.minimum = minimum[self.at]
        self.halves, self.half, self.size = halves, half, words

    def full(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each picked window, of which either half comes from other bits of its words."""
        at = self.at[pick]
        return rolled(self.words, self.size)[at], rolled(self.others, self.size)[at]


def packed(*columns: np.ndarray) -> np.ndarray:
    """Columns of one length as bytes, one after the other."""
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).ravel() for c in columns])


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def sent(slice_of: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """One row for each slice: its number, what kind of entries, and the entries packed."""
    order = np.argsort(slice_of, kind="stable")
    cut = np.flatnonzero(np.diff(slice_of[order])) + 1
    parts = np.split(order, cut) if len(order) else []
    blobs = [packed(*(c[p] for c in columns)) for p in parts]
    if blobs:
        data = binary_array(np.concatenate(blobs), np.cumsum([len(b) for b in blobs]))
        yield pa.RecordBatch.from_arrays([pa.array([int(slice_of[p[0]]) for p in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), data], names=["slice", "kind", "data"])


def told(doc: np.ndarray, value: np.ndarray) -> pa.Table:
    """One row for each document: its id and its values packed."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    last = np.append(np.flatnonzero(np.diff(doc)), len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
    return pa.table({"doc": pa.array(doc[last], pa.int64()), "told": binary_array(value.astype("<i8").view(np.uint8), (last + 1) * 8)})


def firsts(key: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows: which head a run of equal ones, and which stand elsewhere than the head of theirs."""
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    of = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.zeros(0, np.int64)
    return head, (doc != doc[of]) | (place != place[of])


ASK, KNOWN = 0, 1
SENT = "slice int, kind int, data binary"
TOLD = "doc long, told binary"


def ask_halves(words: int, n_slices: int):
    """Level 1, from texts: which least halves of mine are repeated?"""

    def flush(h: list[np.ndarray], doc: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        value, first, n = np.unique(h, return_index=True, return_counts=True)
        # asked once for each half; what is repeated here is known, but others must hear of it
        yield from sent((value % U64(n_slices)).astype(np.int64), [value, doc[first], np.minimum(n, 2).astype(np.uint8)], ASK)
        again = np.repeat(n > 1, n)
        yield from sent((mixed(doc[again].view(U64)) % U64(n_slices)).astype(np.int64), [h[again], doc[again]], KNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, docs, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, off = buffers(batch.column(2))
            for a, b in slices(off):
                w = Windows(raw[off[a] : off[b]], off[a : b + 1] - off[a], words)
                if not len(w.at):
                    continue
                # one entry for each place of a least half
                place = least_places(w)
                hs.append(w.halves[place])
                docs.append(ids[a + np.searchsorted(w.first, place, side="right") - 1])
                size += len(place)
                if size >= GATHER:
                    yield from flush(hs, docs)
                    hs, docs, size = [], [], 0
        if size:
            yield from flush(hs, docs)

    return run


def least_places(w: Windows) -> np.ndarray:
    """Where the halves stand that are the least of some full window."""
    n = len(w.halves)
    span = w.size - w.half + 1  # halves in a full window
    reach = np.zeros(n + span, U64)
    reach[w.at + span - 1] = w.minimum
    width = 1
    out = reach
    while width * 2 <= span:
        out = np.maximum(out[:-width], out[width:])
        width *= 2
    # the greatest minimum of the windows that hold this half
    top = np.maximum(out[:n], out[span - width : span - width + n])
    held = np.cumsum(np.bincount(w.at, minlength=n + 1) - np.bincount(w.at + span, minlength=n + 1))[:n]
    return np.flatnonzero((w.halves == top) & (held > 0))


def answer_halves(table: pa.Table) -> pa.Table:
    """Level 1, one slice: each document's repeated halves."""
    docs, values, asked = [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == KNOWN:
            h, doc = unpacked(blob, "<u8", "<i8")
            docs.append(doc)
            values.append(h.view(np.int64))
        else:
            asked.append(unpacked(blob, "<u8", "<i8", "u1"))
    if asked:
        h, doc, n = (np.concatenate(x) for x in zip(*asked, strict=True))
        _, inverse = np.unique(h, return_inverse=True)
        repeated = (np.bincount(inverse, n) > 1)[inverse]
        docs.append(doc[repeated])
        values.append(h[repeated].view(np.int64))
    return told(np.concatenate(docs), np.concatenate(values))


def ask_windows(words: int, n_slices: int):
    """Level 2, from texts and their repeated halves: am I the earliest of my windows?"""

    def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, check, doc, place, minimum = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, check, key))
        key, check, doc, place, minimum = (x[order] for x in (key, check, doc, place, minimum))
        head, later = firsts(key, check, doc, place)
        first = np.flatnonzero(head)
        first = first[np.lexsort((place[first], doc[first]))]
        yield from sent((minimum[first] % U64(n_slices)).astype(np.int64), [key[first], check[first], doc[first], place[first]], ASK)
        yield from sent((mixed(doc[later].view(U64)) % U64(n_slices)).astype(np.int64), [place[later], doc[later]], KNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            has = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                continue
            batch = batch.take(pa.array(has))
            ids, ranks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, off = buffers(batch.column(2))
            known = batch.column(3)
            for a, b in slices(off):
                w = Windows(raw[off[a] : off[b]], off[a : b + 1] - off[a], words)
                if not len(w.at):
                    continue
                mine = [unpacked(x, "<i8")[0].view(U64) for i in range(a, b) for x in known[i].as_py()]
                pick = np.flatnonzero(np.isin(w.minimum, np.concatenate(mine)))
                key, check = w.full(pick)
                row = a + w.row[pick]
                parts.append([key, check, ids[row], (ranks[row] << 32) + w.place[pick], w.minimum[pick]])
                size += len(pick)
                if size >= GATHER:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def answer_windows(table: pa.Table) -> pa.Table:
    """Level 2, one slice: each document's windows that also start earlier."""
    docs, values, asked = [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == KNOWN:
            place, doc = unpacked(blob, "<i8", "<i8")
            docs.append(doc)
            values.append(place)
        else:
            asked.append(unpacked(blob, "<u8", "<u8", "<i8", "<i8"))
    if asked:
        key, check, doc, place = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.lexsort((place, doc, check, key))
        key, check, doc, place = (x[order] for x in (key, check, doc, place))
        _, later = firsts(key, check, doc, place)
        docs.append(doc[later])
        values.append(place[later])
    return told(np.concatenate(docs), np.concatenate(values))


def removals(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    """Each batch with (number of words, removed, kept text) of its rows."""
    for batch in batches:
        ranks = batch.column(1).to_numpy()
        out = []
        for rank, text, known in zip(ranks.tolist(), batch.column(2), batch.column(3), strict=True):
            own = text.as_py().split()  # ASCII white space, as the text is bytes
            n = len(own)
            lists = known.as_py()
            if lists:
                at = np.concatenate([unpacked(x, "<i8")[0] for x in lists])
                at = at[at >> 32 == rank] & 0xFFFFFFFF
                keep = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + words, minlength=n + 1))[:n] == 0
                own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
            out.append((n, n - len(own), b" ".join(own)))
        yield batch, out


def with_rank(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, rank, t)``: rows that share an id are told apart by a rank in the order of a text hash; null ids come last."""
    if not isinstance(docs.schema[doc].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{doc} must hold whole numbers")
    none = F.when(F.col(doc).isNull(), NO_RANK).otherwise(0).cast("long").alias("rank")
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), none, F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = rows.groupBy("doc", "rank").agg(F.count("*").alias("n")).where("n > 1").select("doc", "rank")
    if ids.isEmpty():
        return rows.select("doc", "rank", F.col("t").cast("binary").alias("t"))
    hashed = rows.withColumn("h", F.xxhash64("t"))
    ranks = hashed.select("doc", "rank", "h").join(ids, ["doc", "rank"], "left_semi").distinct().withColumn("more", F.row_number().over(W.partitionBy("doc", "rank").orderBy("h")) - 1)
    ranked = hashed.join(ranks, ["doc", "rank", "h"], "left")
    return ranked.select("doc", (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.col("t").cast("binary").alias("t"))


def slice_count(docs: DataFrame) -> int:
    """Enough slices for the bytes of the texts, so that none outgrows a task."""
    total = docs.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    return max(LEAST_SLICES, -(-total // SLICE_BYTES))


def survivors(docs: DataFrame, words: int, n_slices: int) -> DataFrame:
    """``docs`` (doc, rank, t) with ``told``: packed hashes of their least halves that are repeated, or null."""
    halves = docs.mapInArrow(tidy(ask_halves(words, n_slices)), SENT).groupBy("slice").applyInArrow(answer_halves, TOLD)
    halves = halves.groupBy("doc").agg(F.collect_list("told").alias("told"))
    return docs.join(halves.hint("shuffle_hash"), "doc", "left").select("doc", "rank", "t", "told")


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` (doc, rank, t) with ``told``: packed places of the windows that also start earlier, or null."""
    n_slices = slice_count(docs)
    later = survivors(docs, words, n_slices).mapInArrow(tidy(ask_windows(words, n_slices)), SENT).groupBy("slice").applyInArrow(answer_windows, TOLD)
    later = later.groupBy("doc").agg(F.collect_list("told").alias("told"))
    return docs.join(later.hint("shuffle_hash"), "doc", "left").select("doc", "rank", "t", "told")


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """``(doc, n_words, n_removed, kept_sha256[, kept])`` for each row of ``docs``.

    A window is ``words`` words (between ASCII white space) of one row. Words covered by
    a window that also starts earlier (smaller id, or same id and earlier) are removed;
    all windows are judged on the input. Rows that share an id count as one document
    whose rows follow each other in the order of a text hash, and rows that repeat both
    id and text as one row; null ids come after all others and are given back as null.
    Null and empty texts have no words; texts of any length are looked at whole; other
    columns are not looked at; an empty table gives no rows. Ids of a type other than whole
    numbers are refused.
    """
    if words < 2:
        raise ValueError("a window has at least 2 words")
    names = ["doc", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in removals(batches, words):
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            ids = pc.if_else(pc.greater_equal(batch.column(1), NO_RANK), pa.scalar(None, pa.int64()), batch.column(0))
            cols = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())] * keep_text], names=names)

    out = repeated_windows(with_rank(docs, doc, text), words).mapInArrow(tidy(run), "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    return out


def longest(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> list[tuple[int, int]]:
    """[(length, rows with a window of it that also starts earlier)] for ``words`` and its doublings, until no window survives.

    Only rows with a window repeated at one length are looked at for twice that length.
    """
    live, out = with_rank(docs, doc, text), []
    while True:
        live = materialize(survivors(live, words, slice_count(live)).where("told is not null").drop("told"), "level")
        n = repeated_windows(live, words).where("told is not null").count()
        if not n:
            break
        out.append((words, n))
        words *= 2
    return out
