"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased and white space is squeezed. If an item of m
characters occurs in a document with at most k edits, at least m - q + 1 - kq of
its q-grams occur there on diagonals (document position minus item position) that
differ by at most k. So shared q-grams are counted in diagonal bands of width
2(k+1) that overlap by half: some band holds a whole occurrence. Bands that meet
the bound are verified by a banded alignment of the item against that region. k is the
error rate times m, rounded down, at every length; with ``whole_words`` a place must begin and end
at a word's edge, or the item 'a' is found in most texts.

Documents are read once and never shuffled. Texts of items go to the executors, which index them in blocks of
at most BLOCK_CHARS characters and hold one block at a time; beyond BLOCKS blocks the benchmark takes one more
pass over the documents for each BLOCKS of them, not more memory.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, buffers, mixed, slices, tidy, unused

ERROR_RATE = 0.05
#: Characters of items that a worker holds the q-grams of, at some 40 bytes each, and blocks that are sent at once.
BLOCK_CHARS, BLOCKS = 4_000_000, 16
#: Bytes of documents that are searched for one block after the other.
CHUNK_BYTES = 32 << 20
Q_SIZES = (12, 8, 6, 4, 3, 2, 1)
BASE = U64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
#: Cells of an alignment that are compared in one step, after which one that has gone beyond its budget is given up.
ALIGNED_CELLS = 4096


def normalized(text: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))


def edit_budget(m: int, rate: float) -> tuple[int, int, int]:
    """(k, q, bound): the longest q whose bound says something about k edits in m characters."""
    k = int(rate * m)
    q = next(q for q in Q_SIZES if m - q + 1 - k * q >= max(1, m // 8) or q == 1)
    return k, q, max(1, m - q + 1 - k * q)


def grams(cp: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each position."""
    if len(cp) < q:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out, done = None, 0
        part, width = mixed(cp.astype(U64) + U64(1)), 1
        while width <= q:
            if q & width:
                if out is None:
                    out, done = part[: len(cp) - q + 1], width
                else:
                    out = out * (BASE ** U64(width)) + part[done : done + len(cp) - q + 1]
                    done += width
            if width * 2 <= q:
                part = part[:-width] * (BASE ** U64(width)) + part[width:]
            width *= 2
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


Item = tuple[object, str]  # id, normalised text


class Index:
    """The q-grams of some items, for one q."""

    def __init__(self, items: list[Item], q: int, rate: float):
        self.q, self.items = q, items
        budget = [edit_budget(len(t), rate) for _, t in items]
        self.k = np.array([b[0] for b in budget], np.int64)
        self.bound = np.array([b[2] for b in budget], np.int64)
        hs = [grams(codes(t), q) for _, t in items]
        h = np.concatenate(hs)
        item = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        pos = np.concatenate([np.arange(len(x)) for x in hs])
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[mixed(self.grams) >> U64(64 - FILTER_BITS)] = True

    def hits(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of every shared gram."""
        h = grams(cp, self.q)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.filter[mixed(h) >> U64(64 - FILTER_BITS)])
        j = np.searchsorted(self.grams, h[at])
        j[j == len(self.grams)] = 0
        ok = self.grams[j] == h[at]
        at, j = at[ok], j[ok]
        n = self.count[j]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        e = np.repeat(self.first[j], n) + inner
        return np.repeat(at, n), self.item[e], self.pos[e]


def word_edges(cp: np.ndarray) -> np.ndarray:
    """Whether a word (letters, digits and underscores of any script) may begin or end before each character and at the end."""
    inside = np.zeros(len(cp) + 2, bool)
    inside[1:-1] = np.fromiter((c.isalnum() or c == "_" for c in cp.tobytes().decode("utf-32-le", "surrogatepass")), bool, len(cp))
    return ~(inside[:-1] & inside[1:])


def banded(item: np.ndarray, region: np.ndarray, k: int, edges: np.ndarray | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``region``, or None beyond k edits.

    Free ends in the region, at ``edges`` only if they are given; the diagonals from 0 to len(region) - len(item) with k
    to either side are the band. Among equal edits the earliest end, then the longest match.
    """
    m, n = len(item), len(region)
    lo, width = -k, max(0, n - m) + 2 * k + 1  # row i covers region ends i + lo ... i + lo + width - 1
    big = m + n + 1
    cols = np.arange(width)
    j = lo + cols
    free = (j >= 0) & (j <= n)
    if edges is not None:
        free &= edges[np.clip(j, 0, n)]
    cost = np.where(free, 0, big)
    start = np.append(j, 0)
    up = np.full(width, big + 1)
    ends = np.concatenate([np.full(k + 1, -1), region, np.full(max(0, m - n) + k + 1, -1)])  # -1: outside the region
    ends = np.lib.stride_tricks.sliding_window_view(ends, width)
    rows = max(1, ALIGNED_CELLS // width)
    for first in range(0, m, rows):
        under = ends[first + 1 : first + 1 + min(rows, m - first)]
        away = np.where(under < 0, big, under != item[first : first + len(under), None])
        for i, other in enumerate(away, first + 1):
            np.add(cost[1:], 1, out=up[:-1])
            sub = cost + other
            s = np.where(up < sub, start[1:], start[:-1])
            run = np.minimum(up, sub) - cols  # a move along the row costs one for each column
            low = np.minimum.accumulate(run)
            src = np.maximum.accumulate(np.where(run == low, cols, 0))
            cost = low + cols
            cost[max(0, n + 1 - i - lo) :] = big
            start[:-1] = s[src]
        if cost.min() > k:  # no later row has less
            return None
    if edges is not None:
        cost = np.where(edges[np.clip(m + lo + cols, 0, n)], cost, big)
    e = int(np.argmin(cost))
    if cost[e] > k:
        return None
    return int(cost[e]), int(start[e]), int(m + lo + e)


def leaks_in(cp: np.ndarray, bounds: np.ndarray, index: Index, whole_words: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) in texts laid end to end in ``cp`` and cut at ``bounds``."""
    at, item, pos = index.hits(cp)
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + index.q <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    at, item, pos, row = at[inside], item[inside], pos[inside], row[inside]
    if not len(at):
        return []
    step = index.k[item] + 1
    band = np.floor_divide(at - bounds[row] - pos, step)
    row2, item2, pos2 = np.tile(row, 2), np.tile(item, 2), np.tile(pos, 2)
    band2 = np.concatenate([band, band - 1])
    order = np.lexsort((pos2, band2, item2, row2))
    r, i, b, p = row2[order], item2[order], band2[order], pos2[order]
    new_key = np.ones(len(r), bool)
    new_key[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
    distinct = new_key.copy()
    distinct[1:] |= p[1:] != p[:-1]
    heads = np.flatnonzero(new_key)
    shared = np.add.reduceat(distinct.astype(np.int64), heads)
    out: list[tuple[int, int, int, int, int]] = []
    edge_of: dict[int, np.ndarray] = {}
    for h in heads[shared >= index.bound[i[heads]]]:
        x, t = int(i[h]), index.items[i[h]][1]
        k, begin, end = int(index.k[x]), int(bounds[r[h]]), int(bounds[r[h] + 1])
        lo = max(0, int(b[h]) * (k + 1) - k)
        hi = min(end - begin, (int(b[h]) + 2) * (k + 1) + len(t) + k)
        edges = None
        if whole_words:
            if begin not in edge_of:
                edge_of = {begin: word_edges(cp[begin:end])}
            edges = edge_of[begin][lo : hi + 1]
        found = banded(codes(t), cp[begin + lo : begin + hi], k, edges)
        if found:
            out.append((int(r[h]), x, found[0], lo + found[1], lo + found[2]))
    return apart(out)


def apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of places of one item in one row that overlap, the one with fewest edits, then the earliest."""
    kept: list[tuple[int, int, int, int, int]] = []
    for _, same in itertools.groupby(sorted(set(found)), key=lambda o: o[:2]):
        starts: list[int] = []
        ends: list[int] = []  # of the places kept so far, which do not overlap
        for o in same:
            at = bisect.bisect_left(starts, o[4])  # those before begin before this one ends
            if not at or ends[at - 1] <= o[3]:
                starts.insert(at, o[3])
                ends.insert(at, o[4])
                kept.append(o)
    return kept


def indexes(items: list[Item], rate: float) -> list[Index]:
    by_q: dict[int, list[Item]] = {}
    for x in items:
        by_q.setdefault(edit_budget(len(x[1]), rate)[1], []).append(x)
    return [Index(v, q, rate) for q, v in sorted(by_q.items(), reverse=True)]


def text_leaks(column: pa.Array, found: list[Index], whole_words: bool = False) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item id, edits, start, end) in a column of normalised texts."""
    raw, off = buffers(column)
    for a, b in slices(off):
        text = raw[off[a] : off[b]]
        cp = codes(text.tobytes().decode("utf-8", "replace"))
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        bounds = chars[off[a : b + 1] - off[a]]
        for index in found:
            for row, x, *rest in leaks_in(cp, bounds, index, whole_words):
                yield (a + row, index.items[x][0], *rest)


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[Item]]:
    """The items that are not empty, normalised, in blocks of at most BLOCK_CHARS characters (or one item)."""
    rows = benchmark.select(F.col(item).alias("i"), normalized(text).alias("t")).where("t <> ''").distinct().orderBy("i", "t")
    block: list[Item] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


#: The last block that a worker has indexed: benchmarks of one block are indexed once a worker.
_indexed: dict[tuple[str, int], list[Index]] = {}


def indexed(name: str, number: int, items: list[Item], rate: float) -> list[Index]:
    if (name, number) not in _indexed:
        _indexed.clear()
        _indexed[name, number] = indexes(items, rate)
    return _indexed[name, number]


Leaks = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[tuple[int, object, int, int, int]]]]]


def searches(benchmark: DataFrame, item: str, item_text: str, rate: float, whole_words: bool) -> Iterator[Leaks]:
    """For each BLOCKS blocks of items a function from batches, whose last column is the normalised text, to batches and what they leak."""
    sent = blocks(benchmark, item, item_text)
    while some := list(itertools.islice(sent, BLOCKS)):
        shared, name = benchmark.sparkSession.sparkContext.broadcast(some), uuid.uuid4().hex

        def leaks(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[tuple[pa.RecordBatch, list]]:
            for chunk in chunks(batches):
                found = [[] for _ in chunk]
                for number, items in enumerate(shared.value):
                    index = indexed(name, number, items, rate)
                    for batch, out in zip(chunk, found, strict=True):
                        out += text_leaks(batch.column(batch.num_columns - 1), index, whole_words)
                yield from zip(chunk, found, strict=True)

        yield leaks


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, whole_words: bool = False) -> DataFrame:
    """``(doc, item, edits, start, end)`` of the places where an item occurs within its edit budget; of places that overlap, the one with fewest edits, then the earliest.

    ``start`` and ``end`` count characters of the normalised text. Null and empty texts
    leak nothing, null and empty items are in nothing; ids of both tables may have any type and be null;
    repeated rows and repeated ids each give their own rows; extra columns are not looked at; an empty
    table on either side gives no rows. Documents of any length are looked at whole.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("item", benchmark.schema[item].dataType), *T.StructType.fromDDL("edits int, start long, end long")])
    out = docs.sparkSession.createDataFrame([], schema)
    for leaks in searches(benchmark, item, item_text, rate, whole_words):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], leaks=leaks) -> Iterator[pa.RecordBatch]:
            kinds = to_arrow_schema(schema)
            for batch, found in leaks(batches):
                if found:
                    row, *rest = zip(*found, strict=True)
                    cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, f.type) for x, f in zip(rest, list(kinds)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "item", "edits", "start", "end"])

        out = out.union(docs.select(F.col(doc).alias("doc"), normalized(text).alias("t")).mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, whole_words: bool = False) -> DataFrame:
    """``docs`` without the rows in which any item occurs; same columns, nothing is shuffled.

    Null and empty texts stay, as do all rows if the benchmark is empty; every repeated row is
    judged for itself; ids are not looked at; other columns may have any name.
    """
    for leaks in searches(benchmark, item, item_text, rate, whole_words):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], leaks=leaks, n=len(docs.columns)) -> Iterator[pa.RecordBatch]:
            for batch, found in leaks(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in found]] = False
                yield batch.select(range(n)).filter(pa.array(keep))

        docs = docs.withColumn(unused(docs, "__normalized"), normalized(text)).mapInArrow(run, docs.schema)
    return docs
