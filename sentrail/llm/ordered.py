"""SHA-256 over the rows of a key in order, where one key may hold any share of the rows.

Rows are dealt by range of key and order and streamed. A key that is neither the first nor the last of its part
lies whole in it and is hashed there; of the others, and of keys over PIECE bytes, pieces go on to one more
task, which takes them in order. A hash is a sequence, so the bytes of one key pass through one task in the
end, but never lie in memory together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import tidy

PIECE = 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()

Lines = Callable[[Iterator[tuple]], Iterator[tuple[tuple, bytes]]]


def tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def pieces(lines: Iterator[tuple[tuple, bytes]], sep: bytes) -> Iterator[tuple[tuple, int, bool, bytes]]:
    """(key, number, whole, data): the digest of a key that lies between two others, else its bytes in pieces."""
    key, first, number, held, size = None, True, 0, [], 0
    for k, line in lines:
        if held and k != key:
            if first or number:
                yield key, number, False, sep.join(held)
            else:
                yield key, 0, True, hashlib.sha256(sep.join(held)).digest()
            first, number, held, size = False, 0, [], 0
        key = k
        if size > PIECE:
            yield key, number, False, sep.join(held)
            number, held, size = number + 1, [], 0
        held.append(line)
        size += len(line) + len(sep)
    if held:
        yield key, number, False, sep.join(held)


def ordered_digests(rows: DataFrame, key: list[str], place: list[str | Column], lines: Lines, sep: bytes, after: tuple[str, ...] = ()) -> DataFrame:
    """``(key, sha256)``: for each key that has lines, the lower-case hash of these, joined by ``sep``.

    ``rows`` are dealt by ``key`` and ``place``; rows alike in both stay together, in the order of ``after``.
    ``lines`` gets the rows of a part as tuples and gives (key, bytes), keys ascending.
    """
    fields = [rows.schema[c] for c in key]

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from written(((*k, part, n, whole, data) for k, n, whole, data in pieces(lines(tuples(batches)), sep)), schema)

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, h = None, None
            for row in tuples(batches):
                k = row[: len(key)]
                if h is None or k != now:
                    if h is not None:
                        yield (*now, h.hexdigest())
                    now, h = k, hashlib.sha256()
                else:
                    h.update(sep)
                h.update(row[-1])
            if h is not None:
                yield (*now, h.hexdigest())

        yield from written(out(), done)

    schema = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("data", T.BinaryType())])
    done = T.StructType([*fields, T.StructField("sha256", T.StringType())])
    dealt = rows.repartitionByRange(*key, *place).sortWithinPartitions(*key, *place, *after)
    got = materialize(dealt.mapInArrow(cut, schema), "pieces")
    rest = got.where("not whole").select(*key, "part", "piece", "data").repartition(*key).sortWithinPartitions(*key, "part", "piece")
    return got.where("whole").select(*key, F.lower(F.hex("data")).alias("sha256")).unionByName(rest.mapInArrow(finish, done))


def written(rows: Iterable[tuple], schema: T.StructType, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``most`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = zip(*held, strict=True) if held else [[] for _ in kind]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    yield batch()
