"""A join of texts by edit similarity whose candidates share a piece: no block is compared with itself.

Texts of length l may differ in k(l) edits at a threshold. Of the k + 1 pieces into which a text is cut, one is
untouched by k edits, so a text that is alike has it too, at a place that the edits before and after it allow. The
longer text of a pair gives its pieces, the shorter one the pieces that it could share with texts of each
length that is near enough; both meet by (block, length, number of the piece, piece).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def allowed(length: Column, threshold: float) -> Column:
    """Edits between a text of ``length`` and one no longer, at ``1 - edits / length >= threshold``."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def piece_at(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of piece ``i`` of ``k + 1`` even ones; the last are longer by one where they must."""
    size = F.floor(length / (k + 1)).cast("int")
    plain = k + 1 - length % (k + 1)
    return i * size + F.greatest(F.lit(0), i - plain), size + (i >= plain).cast("int")


def own_pieces(n: Column, threshold: float) -> Column:
    length = F.length(n)
    k = allowed(length, threshold)

    def piece(i: Column) -> Column:
        start, size = piece_at(length, k, i)
        return F.struct(length.alias("length"), i.alias("i"), F.substring(n, start + 1, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), k), piece)


def possible_pieces(n: Column, threshold: float) -> Column:
    """Of each length that a longer text may have, the pieces that this one could share with it.

    Piece i lies no further from its place than i edits before it and k - i after it allow.
    """
    length = F.length(n)
    none = F.array().cast("array<struct<length:int,i:int,piece:string>>")

    def of_length(other: Column) -> Column:
        k = allowed(other, threshold)

        def of_piece(i: Column) -> Column:
            start, size = piece_at(other, k, i)
            low = F.greatest(F.lit(0), start - i, start + length - other - (k - i))
            high = F.least(length - size, start + i, start + length - other + (k - i))
            cut = F.transform(F.sequence(low, F.greatest(low, high)), lambda at: F.struct(other.alias("length"), i.alias("i"), F.substring(n, at + 1, size).alias("piece")))
            return F.when(low <= high, cut).otherwise(none)

        return F.when(other - length <= k, F.flatten(F.transform(F.sequence(F.lit(0), k), of_piece))).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(F.sequence(length, F.greatest(length, F.floor(length / threshold + 1e-9).cast("int"))), of_length)))


def candidates(texts: DataFrame, threshold: float, block: Sequence[str] = (), text: str = "n") -> DataFrame:
    """``(a, b)``, a the longer (or the greater of one length): pairs that share a piece, as often as they do."""
    n = F.col(text)
    left = texts.select(*block, n.alias("a"), F.explode(own_pieces(n, threshold)).alias("p")).select(*block, "a", "p.*")
    right = texts.select(*block, n.alias("b"), F.explode(possible_pieces(n, threshold)).alias("p")).select(*block, "b", "p.*")
    return left.join(right, [*block, "length", "i", "piece"]).where((F.length("a") > F.length("b")) | (F.col("a") > F.col("b"))).select("a", "b")


def edit_join(texts: DataFrame, threshold: float = 0.8, block: Sequence[str] = (), text: str = "n") -> DataFrame:
    """``(a, b, similarity)``: all pairs of distinct ``texts`` in one block whose edit similarity reaches ``threshold`` (above 0), each once.

    A piece that very many texts share makes pairs of them all; adaptive execution splits its partition.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    near = candidates(texts, threshold, block, text).where(F.levenshtein("a", "b", 1_000_000) <= allowed(F.length("a"), threshold))
    return near.distinct().withColumn("similarity", T.edit_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)
