"""Name and phonetic functions, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles stripped from names, and phonetic replacements in order.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Jr", "Sr", "III", "II", "IV")
PHONETIC = (("^KN", "N"), ("^GN", "N"), ("^PN", "N"), ("^AE", "E"), ("^WR", "R"), ("^WH", "W"), ("MB$", "M"), ("GH", ""), ("PH", "F"), ("CK", "K"), ("SH", "X"), ("TH", "0"), ("CH", "X"), ("SCH", "SK"), ("DG", "J"))


def normalized_name(c: Column) -> Column:
    """Letters, digits and white space only; trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 if equal, else 1 - edits / longer length; null if either is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longer.cast("double")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Case-folded; 1 if both are empty, 0 if one is; null counts as empty."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(edit_similarity(a, b))


def coded_soundex(c: Column) -> Column:
    """Soundex in which every letter without a digit (H and W too) ends a run; '0000' for empty names."""
    up = F.upper(F.coalesce(c, F.lit("")))
    digits = F.translate(F.regexp_replace(up, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    runs = F.regexp_replace(digits, r"(.)\1+", "$1")
    rest = F.regexp_replace(F.substring(runs, 2, 100_000), "0", "")
    return F.when(up == "", "0000").otherwise(F.rpad(F.concat(F.substring(up, 1, 1), F.substring(rest, 1, 3)), 4, "0"))


def metaphone(c: Column) -> Column:
    """Simplified phonetic key of at most six letters."""
    out = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    for pattern, by in PHONETIC:
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, 6)


def ngrams(c: Column, n: int) -> Column:
    """Character n-grams without spaces, in order; a shorter text is its own gram."""
    low = F.lower(F.coalesce(c, F.lit("")))
    packed = F.regexp_replace(low, " ", "")
    return F.when(F.length(packed) < n, F.array(packed)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(packed) - n + 1)), lambda i: F.substring(packed, i, F.lit(n))))


def blocking_ngrams(c: Column, n: int = 3, most: int = 3) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.length(low) < n, F.array(low)).otherwise(F.slice(ngrams(c, n), 1, most))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def gram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def token_similarity(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def phonetic_similarity(a: Column, b: Column) -> Column:
    return _same_code(coded_soundex(a), coded_soundex(b))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def jaro(a: Column, b: Column, folded: bool = False) -> Column:
    """Jaro similarity, case-folded (unless both are already), with greedy matches from the left."""
    if not folded:
        a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    n, m = F.length(a), F.length(b)
    window = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)
    none = F.array().cast("array<int>")

    def match(taken: Column, i: Column) -> Column:
        near = F.sequence(F.greatest(F.lit(1), i - window), F.greatest(F.lit(1), F.least(m, i + window)))
        free = F.filter(near, lambda j: (F.substring(b, j, F.lit(1)) == F.substring(a, i, F.lit(1))) & ~F.array_contains(taken, j) & (j >= i - window) & (j <= i + window) & (j <= m))
        return F.concat(taken, F.array(F.when(F.size(free) > 0, F.array_min(free)).otherwise(-i)))

    places = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), none, match)  # the match in b of each letter of a, or minus its place

    def score(places: Column, hits: Column) -> Column:
        k = F.size(hits).cast("double")
        left = F.transform(F.filter(F.transform(places, lambda j, i: F.struct(j.alias("j"), (i + 1).alias("i"))), lambda p: p["j"] > 0), lambda p: F.substring(a, p["i"], F.lit(1)))
        right = F.transform(F.array_sort(hits), lambda j: F.substring(b, j, F.lit(1)))
        moved = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d)) / 2.0
        return F.when(k == 0, 0.0).otherwise((k / n + k / m + (k - moved) / k) / 3)

    matched = _let(places, lambda p: _let(F.filter(p, lambda j: j > 0), lambda h: score(p, h)))
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(matched)


def jaro_winkler(a: Column, b: Column, p: float = 0.1, folded: bool = False) -> Column:
    """Jaro with a bonus for up to four equal first letters, at any score."""
    x, y = (a, b) if folded else (F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit(""))))
    prefix = F.lit(0)
    for n in range(1, 5):
        prefix = F.when((F.length(x) >= n) & (F.length(y) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n)), n).otherwise(prefix)
    return _let(jaro(x, y, folded=True), lambda j: j + prefix * p * (1 - j))


def _mean(winkler: Column, edit: Column, grams: Column, tokens: Column, phonetic: Column) -> Column:
    return winkler * 0.30 + edit * 0.25 + grams * 0.15 + tokens * 0.20 + phonetic * 0.10


def name_score(a: Column, b: Column) -> Column:
    """Weighted mean of the five name similarities."""
    return _mean(jaro_winkler(a, b), levenshtein_similarity(a, b), gram_similarity(a, b, 2), token_similarity(a, b), phonetic_similarity(a, b))


def name_bound(a: Column, b: Column) -> Column:
    """``name_score`` with the best Jaro-Winkler score there is, which is the costly part."""
    return _mean(F.lit(1.0), levenshtein_similarity(a, b), gram_similarity(a, b, 2), token_similarity(a, b), phonetic_similarity(a, b))


def name_facts(c: Column) -> Column:
    """What ``name_score`` needs of a name, so that pairs need not work it out again."""
    return F.struct(F.lower(F.coalesce(c, F.lit(""))).alias("low"), F.array_distinct(ngrams(c, 2)).alias("grams"), F.array_distinct(words(c)).alias("tokens"), coded_soundex(c).alias("soundex"))


def _overlap(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats."""
    n = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double")), F.lit(0.0))


def _same_code(x: Column, y: Column) -> Column:
    same = sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(1, 5)), F.lit(0))
    return F.when(x == y, 1.0).otherwise(same / 4.0)


def facts_score(a: Column, b: Column, bound: bool = False) -> Column:
    """``name_score`` of two ``name_facts``, or ``name_bound`` of them."""
    x, y = a["low"], b["low"]
    edit = F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(edit_similarity(x, y))
    winkler = F.lit(1.0) if bound else jaro_winkler(x, y, folded=True)
    return _mean(winkler, edit, _overlap(a["grams"], b["grams"]), _overlap(a["tokens"], b["tokens"]), _same_code(a["soundex"], b["soundex"]))


def standard_name(c: Column) -> Column:
    """Without titles and punctuation, single spaces."""
    bare = F.regexp_replace(c, r"(?i)\b(" + "|".join(TITLES) + r")\b\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", ""), r"\s+", " "))


def standard_address(c: Column) -> Column:
    for word, short in (("Street", "St"), ("Road", "Rd"), ("Avenue", "Ave")):
        c = F.regexp_replace(c, rf"(?i)\b{word}\b", short)
    return c
