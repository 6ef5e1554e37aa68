"""Shortest paths from many sources at once on a graph in blocks, with a row of numbers for each vertex in place of rows of (source, vertex).

An undirected edge lies in the block of its end of lower degree, so a block has at most as many edges a vertex as the root of
twice their number, and a hub's edges are spread over all blocks. To add up the rows of all neighbours, a block gets those of
the ends that lie elsewhere (mirrors) and sends back one sum for each of them; so a round moves rows by pairs of vertex
and block and not by edges. A block's numbers are a few megabytes, whatever the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Sources at once, numbers of one matrix of a block, and additions of a block in one round, from which follow the blocks.
WIDTH, CELLS, SUMS = 256, 1 << 19, 1 << 24
#: Neighbours whose rows are held at once.
GATHERED = 2048

GRAPH, STATE, MIRROR, PART = range(4)
#: A row is one block's share of the graph, its state, or rows sent from one block to another; ``n`` counts what the round has reached.
ROW = "block int, kind int, n long, a binary, b binary, c binary, d binary, e binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def row_of(block: int, kind: int, n: int, *arrays: np.ndarray) -> tuple:
    return (block, kind, n, *[np.ascontiguousarray(x).tobytes() for x in arrays], *[b""] * (5 - len(arrays)))


def rows_of(table: pa.Table, kind: int, *types: type) -> Iterator[list[np.ndarray]]:
    """The arrays of each row of one kind."""
    for i in np.flatnonzero(table.column("kind").to_numpy() == kind):
        yield [np.frombuffer(table.column(c)[int(i)].as_buffer(), t) for c, t in zip("abcde", types, strict=False)]


class Graph:
    """A block's vertices ``own``, its edges from ``low`` (place in ``own``) to ``up`` (place in ``ends``), and which blocks want which of its vertices."""

    def __init__(self, table: pa.Table):
        self.own, self.low, self.up, self.ends, wants = next(rows_of(table, GRAPH, np.int64, np.int32, np.int32, np.int64, np.int64))
        self.wanted, self.by = wants.reshape(2, -1)


def in_blocks(und: DataFrame, ids: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """(nodes ``(id, num)`` of all ids and ends of ``und``, a written row for each block, number of blocks) for ``width`` numbers a vertex."""
    degree = und.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = materialize(ids.select("id").join(degree, "id", "full").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.monotonically_increasing_id().alias("num")), "nodes")
    total = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("m")).first()
    blocks = max(1, -(-total["n"] * width // CELLS), -(-total["m"] // 2 * width // SUMS))
    end = lambda c, to: nodes.select(F.col("id").alias(c), F.struct("degree", "num").alias(to))
    e = und.join(end("src", "s"), "src").join(end("dst", "t"), "dst").where("s < t").select(F.col("s.num").alias("x"), F.col("t.num").alias("y"))
    e = materialize(e, "oriented")
    of = lambda c: (F.col(c) % blocks).cast("int")
    parts = nodes.select(of("num").alias("block"), F.lit(0).alias("part"), F.col("num").alias("x"), F.lit(0).cast("long").alias("y"))
    parts = parts.unionByName(e.select(of("x").alias("block"), F.lit(1).alias("part"), "x", "y"))
    parts = parts.unionByName(e.select(of("y").alias("block"), F.lit(2).alias("part"), F.col("y").alias("x"), of("x").cast("long").alias("y")).distinct())

    def pack(table: pa.Table) -> pa.Table:
        block, part, x, y = (table.column(c).to_numpy() for c in ("block", "part", "x", "y"))
        own = np.sort(x[part == 0])
        ends, up = np.unique(y[part == 1], return_inverse=True)
        low = np.searchsorted(own, x[part == 1])
        order = np.lexsort((up, low))
        wants = np.stack([np.searchsorted(own, x[part == 2]), y[part == 2]]).astype(np.int64)
        return table_of([row_of(int(block[0]), GRAPH, 0, own, low[order].astype(np.int32), up[order].astype(np.int32), ends.astype(np.int64), wants)])

    graph = materialize(parts.groupBy("block").applyInArrow(pack, ROW), "graph")
    release(e)
    return nodes, graph, blocks


def add_rows(to: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): for each of ``to`` the sum of the rows ``at`` of ``x``; rows of zeros are passed over."""
    some = x.any(axis=1)[at]
    to, at = to[some], at[some]
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    sums = np.zeros((len(heads), x.shape[1]))
    for i, (a, b) in enumerate(zip(heads, np.append(heads, len(to))[1:], strict=True)):
        for c in range(a, b, GATHERED):
            sums[i] += x[at[c : min(b, c + GATHERED)]].sum(axis=0)
    return to[heads], sums


def reached(state: list[np.ndarray], at: int) -> np.ndarray:
    """What goes on from the vertices at distance ``at``: on the way out their numbers of paths, on the way back (1 + delta) / paths."""
    return np.where(state[1] == at, (1 + state[3]) / np.maximum(state[2], 1) if len(state) > 3 else state[2], 0.0)


def rounds(graph: DataFrame, blocks: int, width: int) -> Callable[[DataFrame, int, bool], DataFrame]:
    """A function from the written state of one round to that of the next: ``(state, distance, back)``."""

    def state_of(table: pa.Table) -> list[np.ndarray] | None:
        for nums, dist, paths, delta in rows_of(table, STATE, np.int64, np.int16, np.float64, np.float64):
            return [nums, *[x.reshape(-1, width) for x in (dist, paths, delta) if len(x)]]
        return None

    def send(at: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            g, state = Graph(table), state_of(table)
            x = np.zeros((len(g.ends), width))
            for nums, rows in rows_of(table, MIRROR, np.int64, np.float64):
                x[np.searchsorted(g.ends, nums)] = rows.reshape(-1, width)
            out = []
            for ends, (places, sums) in ((g.own, add_rows(g.low, g.up, x)), (g.ends, add_rows(g.up, g.low, reached(state, at)))):
                nums = ends[places]
                for block in np.unique(nums % blocks):
                    here = nums % blocks == block
                    out.append(row_of(int(block), PART, 0, nums[here], sums[here]))
            return table_of(out)

        return run

    def take(at: int, back: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            g, (nums, dist, paths, *delta) = Graph(table), state_of(table)
            sums = np.zeros(paths.shape)
            for which, rows in rows_of(table, PART, np.int64, np.float64):
                sums[np.searchsorted(nums, which)] += rows.reshape(-1, width)
            if back:
                after = at - 1
                delta = [np.where(dist == after, paths * sums, delta[0] if delta else 0.0)]
                n = 0
            else:
                after, new = at + 1, (dist < 0) & (sums > 0)
                dist, paths, n = np.where(new, np.int16(after), dist), np.where(new, sums, paths), int(new.sum())
            return table_of(written(g, int(table.column("block")[0].as_py()), n, [nums, dist, paths, *delta], after))

        return run

    def step(state: DataFrame, at: int, back: bool) -> DataFrame:
        # the way back begins with numbers of its own, which no mirror has yet
        parts = graph.unionByName(state).groupBy("block").applyInArrow(send(at), ROW)
        return materialize(graph.unionByName(state.where(F.col("kind") == STATE)).unionByName(parts).groupBy("block").applyInArrow(take(at, back), ROW), "vectors")

    return step


def written(g: Graph, block: int, n: int, state: list[np.ndarray], at: int) -> list[tuple]:
    """The rows of a block's state and of what other blocks want of it in the round from distance ``at``."""
    x = reached(state, at)
    some = x.any(axis=1)[g.wanted]
    wanted, by = g.wanted[some], g.by[some]
    mirrors = [row_of(int(b), MIRROR, 0, g.own[wanted[by == b]], x[wanted[by == b]]) for b in np.unique(by)]
    return [row_of(block, STATE, n, *state), *mirrors]


def dependencies(nodes: DataFrame, graph: DataFrame, blocks: int, sources: DataFrame) -> DataFrame:
    """``(id, s2, q2)``: for each vertex the sum, and the sum of squares, of how much the shortest paths from each other of ``sources`` depend on it, by Brandes' recurrences."""
    firsts = np.array(sorted(r["num"] for r in nodes.join(sources, "id", "left_semi").select("num").collect()), np.int64)  # WIDTH or so
    width = len(firsts)
    if not width:
        return nodes.limit(0).select("id", F.lit(0.0).alias("s2"), F.lit(0.0).alias("q2"))

    def begin(back: int | None = None) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            g, block = Graph(table), int(table.column("block")[0].as_py())
            if back is None:
                mine = np.flatnonzero(np.isin(firsts, g.own))
                dist, paths = np.full((len(g.own), width), -1, np.int16), np.zeros((len(g.own), width))
                dist[np.searchsorted(g.own, firsts[mine]), mine], paths[np.searchsorted(g.own, firsts[mine]), mine] = 0, 1
                return table_of(written(g, block, len(mine), [g.own, dist, paths], 0))
            nums, dist, paths = next(rows_of(table, STATE, np.int64, np.int16, np.float64))
            state = [nums, dist.reshape(-1, width), paths.reshape(-1, width), np.zeros((len(nums), width))]
            return table_of(written(g, block, 0, state, back))

        return run

    def sums(table: pa.Table) -> pa.Table:
        nums, s, q = [], [], []
        for own, dist, _, delta in rows_of(table, STATE, np.int64, np.int16, np.float64, np.float64):
            rest = np.where(dist.reshape(-1, width) > 0, delta.reshape(-1, width), 0.0)  # a source does not count for itself
            nums, s, q = own, rest.sum(axis=1), (rest * rest).sum(axis=1)
        return pa.table({"num": pa.array(nums, pa.int64()), "s2": pa.array(s, pa.float64()), "q2": pa.array(q, pa.float64())})

    def on(old: DataFrame, new: DataFrame) -> DataFrame:
        release(old)
        return new

    step = rounds(graph, blocks, width)
    state, at = materialize(graph.groupBy("block").applyInArrow(begin(), ROW), "vectors"), 0
    while state.agg(F.sum("n")).first()[0]:
        state, at = on(state, step(state, at, False)), at + 1
    most = at - 1  # the last round has found nothing
    state = on(state, materialize(graph.unionByName(state.where(F.col("kind") == STATE)).groupBy("block").applyInArrow(begin(most), ROW), "vectors"))
    for d in range(most, 0, -1):
        state = on(state, step(state, d, True))
    found = state.where(F.col("kind") == STATE).groupBy("block").applyInArrow(sums, "num long, s2 double, q2 double")
    out = materialize(nodes.select("id", "num").join(found, "num").select("id", "s2", "q2"), "dependencies")
    release(state)
    return out
