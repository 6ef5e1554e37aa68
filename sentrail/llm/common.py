"""What several operators here need: texts in Arrow batches as numpy arrays, and removal by id or by id and key."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Text bytes that one numpy step works on; a longer document is worked on alone.
SLICE_BYTES = 1 << 19
#: Up to so many 8-byte keys are sent to every executor; more are joined by shuffling.
BROADCAST_KEYS = 500_000

U64 = np.uint64


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes of text, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values whose bytes are cut at ``ends`` (ascending, the last is all)."""
    off = np.concatenate([[0], ends]).astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return out.cast(pa.binary())


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """``docs`` without the rows whose ``on`` values (compared null-safely) are in ``ids``.

    The ids go to every executor only if they are at most BROADCAST_KEYS, which is
    counted first; otherwise both sides are shuffled by id.
    """
    few = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    names = [unused(docs, f"__k{i}") for i in range(len(on))]
    keys = ids.select(*[F.col(c).alias(k) for c, k in zip(on, names, strict=True)])
    cond = [docs[c].eqNullSafe(keys[k]) for c, k in zip(on, names, strict=True)]
    return docs.join(F.broadcast(keys) if few else keys, cond, "left_anti")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: a reused worker then holds no more than its task needs."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    raw, off = buffers(batch.column(at))
    view = memoryview(raw)
    return (bytes(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))


def raw_text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")


def with_key(docs: DataFrame, text: str, key: Callable[[bytes], int]) -> tuple[DataFrame, str]:
    """``docs`` with ``key`` of each row's UTF-8 text as a signed long, and the name of that column."""
    n, name = len(docs.columns), unused(docs, "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([key(t) for t in texts_of(batch, n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], keys], names=[*batch.schema.names[:n], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.select("*", raw_text(text).alias(unused(docs, "__t"))).mapInArrow(run, schema), name


def keep_one(docs: DataFrame, rows: DataFrame, doc: str, text: str, keyed: Callable[[DataFrame], tuple[DataFrame, str]]) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``rows`` ``(doc, key, root)``, which has a row for each of ``docs``.

    The row of least id stays (null ids come last; then the least key, then the least
    text). Where ids are unique they alone travel; otherwise rows are told apart by id and
    key, for which ``keyed`` adds the key to ``docs`` and names its column.
    """
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first"), F.count("*").alias("size")).where("size > 1")
    named = rows.join(first, "root").withColumn("stays", F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.key") == F.col("key")))
    named = materialize(named.select("doc", "key", "stays"), "named")
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return without(docs, named.where("not stays").select(F.col("doc").alias(doc)), [doc])
    both, key = keyed(docs)
    lost = named.where("not stays").select(F.col("doc").alias(doc), F.col("key").alias(key)).distinct()
    twins = named.where("stays").groupBy("doc", "key").count().where("count > 1").select(F.col("doc").alias(doc), F.col("key").alias(key))
    same = [both[doc].eqNullSafe(twins[doc]), both[key] == twins[key]]
    row = unused(both, "__row")
    once = both.join(twins, same, "left_semi").groupBy(doc, key).agg(F.min_by(F.struct(*both.columns), F.coalesce(F.col(text), F.lit(""))).alias(row)).select(f"{row}.*")
    return without(without(both, lost, [doc, key]), twins, [doc, key]).unionByName(once).drop(key)
