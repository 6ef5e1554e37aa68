"""Texts made to collide under weak hashes."""

import random

import numpy as np
from pyspark.sql import functions as F

from sentrail.llm import near_dedup, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, flip):
    """Words of a and b that every polynomial modulo a power of two takes for one."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_words_have_names_of_their_own():
    rng = random.Random(0)
    words = {thue_morse(1024, f).encode() for f in (0, 1)} | {b"x" * n for n in range(1, 40)} | {b"a\0", b"a", b"\0a", "é".encode()}
    words |= {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 24))) for _ in range(5000)}
    words = sorted(words)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    a, b, first = substring.word_hashes(raw, np.array([0, len(raw)]))
    assert len(a) == len(words) == len(set(a.tolist())) == len(set(b.tolist())) and first.tolist() == [0, len(words)]
    again = np.frombuffer(b"\t".join([*words[::-1], b"end"]), np.uint8)
    assert (substring.word_hashes(again, np.array([0, len(again)]))[0][:-1] == a[::-1]).all()


def test_words_that_collide_under_polynomials_are_kept(spark):
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {thue_morse(1024, 0)}"), (2, f"{head} {thue_morse(1024, 1)}"), (3, f"{head} {thue_morse(1024, 0)}")]
    got = {r["doc"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == {1: (20, 0), 2: (20, 0), 3: (20, 20)}


def test_short_texts_that_collide_under_polynomials_stay(spark):
    rows = [(1, f"a b c d {thue_morse(2048, 0)}"), (2, f"a b c d {thue_morse(2048, 1)}"), (3, f"A b c d {thue_morse(2048, 0)}")]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs_of(spark, rows)).collect()) == [1, 2]


def test_names_that_clash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, 11), (3, 5, 10), (4, 6, 12)], "doc long, key long, second long")
    got, clashes = near_dedup.told_apart(rows)
    assert clashes == {5} and {r["doc"]: r["key"] for r in got.collect()} == {1: 10, 2: 11, 3: 10, 4: 6}
    text = b"one two three four five six"
    s, more = next(near_dedup.shingled(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    name, second = near_dedup.names_of(s, more)
    assert near_dedup.class_of(s, more) == name and near_dedup.class_of(s, more, frozenset([name])) == second


def test_large_groups_are_dealt_over_parts(spark, monkeypatch):
    """Many texts share frequent shingles without being alike; some of them are."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        body = " ".join(["all texts begin with these words here"] + [rng.choice(words) for _ in range(14)])
        rows += [(2 * i, body), (2 * i + 1, body + " tail")]
    want = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs_of(spark, rows)).collect())
    monkeypatch.setattr(near_dedup, "GROUP_PART", 5)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs_of(spark, rows)).collect()) == want == list(range(0, 120, 2))
    assert docs_of(spark, rows).agg(F.count("*")).first()[0] == 120
