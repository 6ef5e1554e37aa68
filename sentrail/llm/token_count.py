"""Token counts of documents by heap-and-linked-list byte-pair merging (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordBpe
from .common import tidy

#: A worker keeps one tokenizer, with its caches, for all its tasks.
_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``(doc, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, in one pass without a shuffle.

    ``path`` names the vocabulary file, which must be on every executor. Null texts
    count as empty (0 bytes, 0 tokens); ids may be null or repeated; texts of any
    length are counted whole; other columns are not looked at.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n_bytes", "n_tokens", "over_limit"])
        tokenizer(path).forget()

    t = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, n_bytes long, n_tokens long, over_limit boolean")
