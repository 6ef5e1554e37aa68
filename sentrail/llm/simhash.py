"""Near-duplicates by SimHash, found by anchor-point covering.

Anchors are the words of a linear code of length 64: number the bits 0 to 63; a
word is in the code if the numbers of its set bits sum (by exclusive or) to 0.
Every fingerprint is within 1 bit of an anchor, so the covering radius is 1.

Two fingerprints that differ in at most 2 bits have a word within 1 bit of both,
and that word has an anchor within 1 bit; so both lie within 1 + 1 bits of one
anchor. Each fingerprint is replicated to all anchors within that radius (33, or 2
for an anchor itself), and fingerprints are compared anchor by anchor. At most
1 + 64 + 64*63/2 = 2081 distinct fingerprints lie within 2 bits of an anchor, so
no group grows with the input. Equal fingerprints are one class before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, release
from .common import U64, buffers, keep_one, tidy, with_key

BITS = 64
THRESHOLD = 2
#: Hashes whose bits are counted in one step.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, ``shingle``-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(length)])
    h = xxhash.xxh64_intdigest
    a, b = starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    return majority(np.fromiter((h(joined[x:y], seed) for x, y in zip(a, b, strict=True)), U64, len(a)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((U64(1) << np.flatnonzero(2 * ones > n).astype(U64)).sum()) if (2 * ones > n).any() else 0


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc, fp)``, the fingerprint as a signed long; null and empty texts have 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            view = memoryview(raw)
            fps = [fingerprint(bytes(view[a:b]), shingle, seed) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, U64).view(np.int64))], names=["doc", "fp"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, f"doc {kind}, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for all anchors within 2 bits of each."""
    syndrome = np.zeros(len(fp), np.int64)
    for k in range(6):
        mask = U64(sum(1 << i for i in range(BITS) if i >> k & 1))
        syndrome |= (np.bitwise_count(fp & mask).astype(np.int64) & 1) << k
    at = np.flatnonzero(syndrome == 0)
    out, who = [fp[at], fp[at] ^ U64(1)], [at, at]
    rest = np.flatnonzero(syndrome)
    x, s = fp[rest], syndrome[rest]
    out.append(x ^ (U64(1) << s.astype(U64)))
    who.append(rest)
    i = np.arange(BITS)[None, :]
    j = i ^ s[:, None]
    row, col = np.nonzero(i < j)  # every pair of bits whose numbers sum to the syndrome
    out.append(x[row] ^ (U64(1) << col.astype(U64)) ^ (U64(1) << j[row, col].astype(U64)))
    who.append(rest[row])
    return np.concatenate(out), np.concatenate(who)


def joined_within(fp: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is within ``threshold`` bits, step by step, among the members of one anchor."""
    todo = fp
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            x = front.pop()
            near = np.bitwise_count(todo ^ x) <= threshold
            for y in todo[near].tolist():
                yield int(x), y
            front += list(todo[near])
            todo = todo[~near]


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(src, dst)`` links between the distinct values of ``fp``; with their chains, all that are within ``threshold`` bits."""
    if threshold not in (1, 2):
        raise ValueError("the anchors cover thresholds of 1 and 2 bits")

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(U64)
            for i in range(0, len(whole), 20_000):
                fp = whole[i : i + 20_000]
                anchor, who = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[who].view(np.int64))], names=["anchor", "fp"])

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor, fp = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            held = anchor[cut:], fp[cut:]
            yield found(anchor[:cut], fp[:cut])
        yield found(*held)

    def found(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(anchor))
        pairs = {p for a, b in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True) for p in joined_within(fp[a:b].view(U64), threshold)}
        both = np.array(sorted(pairs), U64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])

    spread_out = fps.select("fp").distinct().mapInArrow(spread, "anchor long, fp long")
    by_anchor = spread_out.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return by_anchor.mapInArrow(compare, "src long, dst long").distinct()


def grouped(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc, fp, root, component)``: ``near_groups`` with the fingerprint that names the component."""
    prints = materialize(fingerprints(docs, doc, text, shingle, seed), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc").alias("rep")), "classes")
    edges = materialize(links(classes, threshold), "links")
    comp = connected_components(edges)
    named = classes.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "components")
    release(edges, comp, classes)
    roots = named.groupBy("component").agg(F.min("rep").alias("root"))
    named = named.join(roots, "component").select("fp", F.col("component").alias("root"), F.col("root").alias("component"))
    return prints.join(named, "fp").select("doc", "fp", "root", "component")


def near_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc, fp, component)``: component is the least id linked, directly or by others.

    One row for each row of ``docs``. Null and empty texts share fingerprint 0 and are
    linked like any other; texts of fewer words than a shingle hash whole; null ids
    count as no id (a component of null ids alone has a null component); repeated rows
    fall together; an empty table gives no rows; other columns are not looked at.
    """
    return grouped(docs, doc, text, threshold, shingle, seed).select("doc", "fp", "component")


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the row of least id of each component; null ids come last, ids may repeat."""
    rows = materialize(grouped(docs, doc, text, threshold).select("doc", F.col("fp").alias("key"), "root"), "near-roots")
    return keep_one(docs, rows, doc, text, lambda d: with_key(d, text, lambda t: int(U64(fingerprint(t)).view(np.int64))))
