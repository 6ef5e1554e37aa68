"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, number of pieces, and attention cost (the
sum of squared lengths). Pieces go in by falling length, each into the open
sequence that it fits under every capacity and that leaves the least weighted norm
of what remains; if none fits, a new one is opened.

Only lengths matter to that, so the packing is worked out for the histogram of
lengths, which has at most as many entries as a sequence has tokens, however many
documents there are. Sequences with the same history stay one range of numbers;
the resulting placements (thousands) say for the r-th piece of a length in which
sequence and where it lies. Numbering the pieces of a length needs no sort: each
task numbers its own, and running sums over tasks make the numbers global.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import CACHE_CHUNKS, CACHE_WORDS, Counts, WordBpe
from .common import BROADCAST_KEYS, tidy

CAPACITY = 4096
#: Weights of the remaining shares of tokens, pieces and attention cost.
WEIGHTS = (1.0, 0.05, 0.05)


class WordIds:
    """Identifiers, as little-endian 32-bit bytes, from the ``tokenizers`` library, piece by piece."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.model, self.id = self.bpe.library.model, self.bpe.library.token_to_id
        self.words, self.chunks = Counts(self.word, CACHE_WORDS), Counts(self.chunk, CACHE_CHUNKS)

    def word(self, piece: str) -> bytes:
        letters = self.bpe.letters
        ids = [t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode("utf-8", "replace")]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.bpe.split(chunk)))

    def forget(self) -> None:
        self.words.clear()
        self.chunks.clear()

    def encode(self, text: str | None) -> bytes:
        out = []
        for part, special in self.bpe.parts(text or ""):
            if special:
                out.append(struct.pack("<I", self.id(part)))
            else:
                out += map(self.chunks.__getitem__, self.bpe.stretches(part))
        return b"".join(out)


_loaded: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def best_fit(histogram: list[tuple[int, int]], capacity: int = CAPACITY, pieces: int = CAPACITY, cost: int = CAPACITY * CAPACITY, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """(placements, number of sequences) for ``(length, count)`` pairs.

    A placement row is (length, first rank, count, first sequence, pieces in each,
    offset of the first): rank first + i lies in sequence first + i // each.
    """
    if pieces < 1 or any(n > capacity or n * n > cost for n, _ in histogram):
        raise ValueError("a piece exceeds a capacity")
    size = 1024
    first, n, tok, doc, att = (np.zeros(size, np.int64) for _ in range(5))
    used, opened = 0, 0
    out: list[tuple[int, int, int, int, int, int]] = []

    def add(*row: int) -> None:
        nonlocal first, n, tok, doc, att, used
        if used == len(first):
            first, n, tok, doc, att = (np.concatenate([x, np.zeros_like(x)]) for x in (first, n, tok, doc, att))
        first[used], n[used], tok[used], doc[used], att[used] = row
        used += 1

    def put(length: int, rank: int, bins: int, each: int, start: int, t: int, d: int, a: int) -> tuple[int, int, int]:
        out.append((length, rank, bins * each, start, each, capacity - t))
        return t - each * length, d - each, a - each * length * length

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        sq = length * length
        if length > 0:
            fits = np.flatnonzero((tok[:used] >= length) & (doc[:used] >= 1) & (att[:used] >= sq))
            left = [(r[fits] - x) / c for r, x, c in ((tok, length, capacity), (doc, 1, pieces), (att, sq, cost))]
            norm = sum(w * x * x for w, x in zip(weights, left, strict=True))
            order = fits[np.argsort(norm, kind="stable")]
        else:
            order = np.flatnonzero(doc[:used] >= 1)
        for i in order.tolist():
            todo = count - rank
            if not todo:
                break
            t, d, a = int(tok[i]), int(doc[i]), int(att[i])
            each = min(t // length, d, a // sq) if length else d
            bins = min(int(n[i]), todo // each)
            rest = int(n[i]) - bins
            if bins:
                tok[i], doc[i], att[i] = put(length, rank, bins, each, int(first[i]), t, d, a)
                n[i] = bins
                rank += bins * each
                if rest:
                    add(int(first[i]) + bins, rest, t, d, a)
                    i = used - 1
            if rest and (few := count - rank):  # less than one more sequence takes
                add(int(first[i]) + 1, int(n[i]) - 1, t, d, a)
                n[i] = 1
                tok[i], doc[i], att[i] = put(length, rank, 1, few, int(first[i]), t, d, a)
                rank += few
        if todo := count - rank:
            each = min(capacity // length, pieces, cost // sq) if length else pieces
            for bins, m in ((todo // each, each), (1, todo % each)):
                if bins and m:
                    left3 = put(length, rank, bins, m, opened, capacity, pieces, cost)
                    add(opened, bins, *left3)
                    opened += bins
                    rank += bins * m
        live = (n[:used] > 0) & (tok[:used] > 0) & (doc[:used] > 0)
        if not live.all():
            k = int(live.sum())
            for x in (first, n, tok, doc, att):
                x[:k] = x[:used][live]
            used = k
    return np.array(out, np.int64).reshape(-1, 6), opened


def cut(docs: DataFrame, path: str, doc: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """``(doc, piece, start, length, ids_crc32, part, rank)``: rank counts within a task and length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        end, seen = struct.pack("<I", end_id), {}
        for batch in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = encode(t.as_py()) + end
                for p in range(0, len(ids), 4 * capacity):
                    part_ids = ids[p : p + 4 * capacity]
                    n = len(part_ids) // 4
                    row.append(i)
                    piece.append(p // (4 * capacity))
                    start.append(p // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part_ids))
                    rank.append(seen.get(n, 0))
                    seen[n] = rank[-1] + 1
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "piece", "start", "length", "ids_crc32", "part", "rank"])
        encoder(path).forget()

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1, pieces: int | None = None, cost: int | None = None) -> DataFrame:
    """``(doc, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece.

    Every row of ``docs`` is a document of its own (repeated rows are packed again);
    null texts are empty and give the end id alone; only documents longer than
    ``capacity`` are cut. ``pieces`` and ``cost`` bound the pieces and the summed
    squared lengths of a sequence; by default neither binds before the tokens do.
    An empty table gives no rows; other columns are not looked at. The cut pieces are
    written to the shared folder (no texts or identifiers), then numbered and placed. Null
    ids are given back as they are.
    """
    if not 0 < capacity < 1 << 15:
        raise ValueError("a sequence has 1 to 32767 tokens")
    spark = docs.sparkSession
    cuts = materialize(cut(docs, path, doc, text, capacity, end_id), "pieces")
    parts = cuts.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    parts = materialize(parts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")), "piece-counts")
    # at most one row for each length up to the capacity
    histogram = [(r["length"], r["n"]) for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()]
    placed, _ = best_fit(histogram, capacity, pieces or capacity, cost or capacity * capacity)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    plan = spark.sparkContext.broadcast(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p[:, 0] << 48) + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            if not len(length):
                continue
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            inner = rank - p[at, 1]
            sequence, place = p[at, 3] + inner // p[at, 4], p[at, 5] + inner % p[at, 4] * length
            cols = [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc].dataType.simpleString()
    base = parts.select("length", "part", "base")  # grows with tasks and lengths: sent around only if few
    base = F.broadcast(base) if base.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else base.hint("shuffle_hash")
    rows = cuts.join(base, ["length", "part"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return rows.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
