"""Frames over busy keys, joins by edit similarity and ranked search, each against a plain version."""

import collections
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrail.functions import segments
from sentrail.operators import fraud, monitoring, ranking, resolution, similarity

START = datetime(2024, 1, 1)


@pytest.fixture
def many_parts(spark):
    """As many parts as there are partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def payments(seed, n, cards):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=rng.choice([rng.randrange(40), rng.randrange(400_000), 3600 * rng.randrange(60)]))
        rows.append((rng.choice(cards), i, rng.choice([1.0, 2.5, 80.0, 300.0]), rng.choice(["US", "GB", None]), rng.choice(["declined", "approved"]), at))
    return rows


CARD = "cardholder_id long, transaction_id long, amount double, merchant_country string, status string, timestamp timestamp"


def plain_cards(rows):
    out, by = {}, collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[5], r[1])):
        before = by[r[0]]
        known = [b for b in before if b[3] is not None]
        other = next(((b[3], b[5]) for b in reversed(known) if r[3] is not None and b[3] != r[3]), None)
        recent = [b for b in before if b[5].replace(microsecond=0) >= r[5].replace(microsecond=0) - timedelta(days=1)]
        out[r[1]] = (max((b[2] for b in before), default=None), sum(b[4] == "declined" for b in before[-10:]) if before else None, min(11, len(recent)), other)
        before.append(r)
    return out


def seen_cards(df, hot_rows):
    got = fraud.card_history(df, hot_rows).collect()
    out = {r["transaction_id"]: (r["max_before"], r["declined_10"], r["count_24h"], r["other_place"] and tuple(r["other_place"])) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("hot_rows", [10, 60, 10_000])
def test_card_history_equals_plain(spark, many_parts, hot_rows):
    rows = payments(1, 500, [1, 1, 1, 2, 3, 4, None])
    assert seen_cards(spark.createDataFrame(rows, CARD), hot_rows) == plain_cards(rows)


def test_card_history_of_one_key_is_spread(spark, many_parts):
    rows = payments(2, 400, [7])
    df = spark.createDataFrame(rows, CARD)
    s = segments.segmented(df, ["cardholder_id"], ["timestamp", "transaction_id"], 50)
    sizes = [r["count"] for r in s.hot.groupBy(segments.PART).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    assert seen_cards(df, 50) == plain_cards(rows)


def test_payments_of_one_second(spark):
    """Only earlier payments count, by time and then id: the twelfth of a second is the first with more than ten before it."""
    rows = [(1, i, 10.0, "US", "approved", START) for i in range(12)]
    got = fraud.card_fraud(spark.createDataFrame(rows, CARD).withColumns({"mcc": F.lit("1"), **{c: F.lit(True) for c in ("is_card_present", "cvv_match", "avs_match", "three_ds")}})).collect()
    assert [(r["transaction_id"], r["indicators"]) for r in got] == [(11, ["high_velocity"])]


@pytest.mark.parametrize("hot_rows", [8, 10_000])
def test_wallet_history_equals_plain(spark, many_parts, hot_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice(["w1", "w1", "w2"]), f"t{rng.randrange(14)}", rng.choice(["BTC", "ETH", "X", "Y", "Z", "V", "W"]), START + timedelta(seconds=rng.randrange(9000))) for i in range(300)]
    got = fraud.wallet_history(spark.createDataFrame(rows, "tx_hash long, from_address string, to_address string, currency string, timestamp timestamp"), hot_rows=hot_rows).collect()
    by, want = collections.defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        b = by[r[1]]
        quick = sum((y[4] - x[4]).total_seconds() < 60 for x, y in zip(b, b[1:], strict=False))
        want[r[0]] = (len(b), len({a for x in b[-10:] for a in x[1:3]}), quick, len({x[3] for x in b[-20:]}))
        b.append(r)
    assert {r["tx_hash"]: (r["rows_before"], r["addresses_10"], r["quick_before"], r["currencies_20"]) for r in got} == want


def test_monitoring_of_busy_senders(spark, many_parts):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), 9500.0 + rng.randrange(700), START + timedelta(hours=rng.randrange(700), seconds=rng.randrange(3))) for i in range(400)]
    tx = spark.createDataFrame(rows, "id long, sender_entity_id long, amount double, transaction_date timestamp").withColumn("risk_score", F.lit(0.1))
    for rule in (monitoring.structuring, lambda t, hot_rows: monitoring.velocity(t, 30, 0.5, hot_rows).withColumn("z_score", F.round("z_score", 9))):
        few, many = ({str(r.asDict()) for r in rule(tx, hot_rows=n).collect()} for n in (10_000, 20))
        assert few == many and few


def test_velocity_that_is_just_the_threshold(spark):
    """Payments a day by sender, of which one has a score of just 3 by whole numbers, whatever doubles say; payments without a time come last."""
    senders = ([4, 3, 1, 2, 1, 1, 2, 9], [1, 1, 3, 2, 2, 3, 2, 1, 1, 2, 2, 2, 2, 1, 2, 1, 4], [3, 1, 3, 1, 2, 1, 1, 2, 2, 2, 2, 2, 1, 2, 2, 1, 4], [2, 2, 1, 3, 2, 2, 1, 2, 1, 3, 2, 1, 1, 2, 1, 2, 4], [4, 6, 1, 4, 2, 3, 2, 2, 10])
    rows = [(s, START + timedelta(days=i, minutes=m)) for s, days in enumerate(senders, 1) for i, n in enumerate(days) for m in range(n)]
    rows += [(0, START + timedelta(days=i, minutes=m)) for i, n in enumerate((1, 1, 1, 2)) for m in range(n)] + [(0, None)] * 4
    tx = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, sender_entity_id long, transaction_date timestamp").withColumn("risk_score", F.lit(0.1))
    found = monitoring.velocity(tx, threshold=3).where("abs(z_score - 3) < 1e-9").collect()
    assert {r["sender_entity_id"] for r in found} == {1, 2, 3, 4, 5} and all(r["z_score"] == 3 for r in found)
    nameless = monitoring.velocity(tx, threshold=1).where("sender_entity_id = 0 and transaction_date is null").orderBy("id").first()
    assert nameless["avg_daily"] == 1.4 and nameless["daily_count"] == 4


def test_running_sums(spark, many_parts):
    rows = spark.range(1000).select(F.when(F.col("id") % 5 < 3, 1).otherwise(F.col("id") % 7 + 2).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = segments.running(segments.parted(rows, ["k"], ["id"]), ["k"], ["id"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    sums = collections.defaultdict(lambda: [0, 0])
    for r in sorted(got, key=lambda r: r["id"]):
        sums[r["k"]][0] += r["v"]
        sums[r["k"]][1] += 1
        assert [r["s"], r["n"]] == sums[r["k"]]


# joins by edit similarity ------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_edit_join_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    texts = {"".join(rng.choice("abñ") for _ in range(rng.randrange(13))) for _ in range(150)} | {"", "a" * 30, "a" * 25 + "b" * 5, "x" + "a" * 29}
    for t in list(texts)[:40]:
        for _ in range(2):
            at = rng.randrange(len(t) + 1)
            texts.add(t[:at] + rng.choice(["", "a", "z"]) + t[at + rng.randrange(2) :])
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["similarity"] for r in similarity.edit_join(spark.createDataFrame([(t,) for t in texts], "n string"), threshold).collect()}
    want = {}
    for a in texts:
        for b in texts:
            if a < b:
                s = 1 - edits(a, b) / max(len(a), len(b))
                if s >= threshold:
                    want[a, b] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_candidates_grow_with_the_names(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(10, 14))) for _ in range(100_000)})
    few, many = (similarity.candidates(spark.createDataFrame([(t,) for t in names[::k]], "n string"), 0.8).count() for k in (10, 1))
    assert many < 20 * len(names) and few < 20 * len(names) / 10  # a block compared with itself: 5 000 000 000 and 50 000 000


def test_links_without_pairs(spark):
    rng = random.Random(6)
    names = ["Maria Garcia", "Maria Garzia", "Mario Garcia", "Peter Smith", "Peter Smyth", None, "", "Zoe"]
    rows = [(i, rng.choice(names)) for i in range(60)]
    people = spark.createDataFrame(rows, "id long, name string")
    pairs = resolution.job_pairs(people).collect()
    want = collections.defaultdict(list)
    for r in pairs:
        want[r["id_a"]].append(r["similarity"])
        want[r["id_b"]].append(r["similarity"])
    got = resolution.job_links(people).collect()
    assert len(got) == 60
    first = {}
    for i, n in rows:
        first.setdefault(n if n is not None else ("none", i), i)
    for r in got:
        w = want[r["id"]]
        assert r["links"] == len(w) and (abs(r["avg_similarity"] - sum(w) / len(w)) < 1e-9 if w else r["avg_similarity"] is None)
        n = rows[r["id"]][1]
        assert r["class_id"] == first[n if n is not None else ("none", r["id"])]


def test_compatible_sets():
    sets = resolution.compatible(0.75)
    bit = {k: 1 << i for i, k in enumerate((*resolution.EXACT, "address"))}
    assert bit["date_of_birth"] not in sets[bit["date_of_birth"]] and bit["tax_id"] in sets[bit["tax_id"]]
    both = bit["national_id"] | bit["address"]
    assert both in sets[both] and bit["national_id"] not in sets[both]


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9])
def test_matching_pairs_equal_all_pairs(spark, threshold):
    """Everything that a score needs, at random, in one block."""
    rng = random.Random(7)
    names = ["Maria Garcia", "Maria Garzia", "Maria Silva", "Mario Garcia", "Maria G"]
    some = lambda *v: rng.choice([None, None, *v])
    rows = []
    for i in range(70):
        at = {"name": rng.choice(names), "date_of_birth": some("1990-01-01", "1991-02-02"), "national_id": some("N1", "N2"), "address": some("1 High St", "2 High St"), "passport": some("P1", "P2"), "tax_id": some("T1", "T2")}
        rows.append((i, "crm", "individual", {k: v for k, v in at.items() if v}))
    records = spark.createDataFrame(rows, "id long, source_system string, entity_type string, attributes map<string,string>")
    found = resolution.matching_pairs(records, ("soundex", "ngram"), threshold).collect()
    assert len({(r["id_a"], r["id_b"]) for r in found}) == len(found)
    a, b = (records.select(F.col("id").alias(f"id_{s}"), F.col("attributes").alias(f"at_{s}")) for s in "ab")
    keys = resolution.blocking_keys(records)
    meet = keys.withColumnRenamed("id", "id_a").join(keys.withColumnRenamed("id", "id_b"), "block").where("id_a < id_b").select("id_a", "id_b").distinct()
    every = meet.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", resolution.pair_score(F.col("at_a"), F.col("at_b")).alias("score")).where(F.col("score") >= threshold)
    group = lambda pairs: {r["id"]: r["cluster"] for r in resolution.clusters(records, pairs, threshold).collect()}
    assert group(resolution.matching_pairs(records, ("soundex", "ngram"), threshold)) == group(every)
    want = {(r["id_a"], r["id_b"]) for r in every.collect()}
    assert {(r["id_a"], r["id_b"]) for r in found} <= want


# ranked search -----------------------------------------------------------------

DOCS = [(1, "Tornado cash, tornado!", "mixer"), (2, "cash desk", None), (3, None, None), (4, "", "  "), (5, "tornados and cashew " * 30, "cash"), (6, "Ünïcode cash", "desk cash"), (7, "nothing here", "x")]


def plain_bm25(docs, query, boosts, fuzzy):
    toks = lambda t: [w for w in re.split(r"[^a-z0-9_]+", (t or "").lower()) if w]
    asked, best = list(dict.fromkeys(toks(query))), collections.defaultdict(float)
    for k, (_, boost) in enumerate(boosts.items(), 1):
        texts = {d[0]: toks(d[k]) for d in docs if toks(d[k])}
        if not texts:
            continue
        mean, df = sum(map(len, texts.values())) / len(texts), collections.Counter(w for t in texts.values() for w in set(t))
        weight = {}
        for term in df:
            near = lambda w: edits(w, term) <= (0 if len(w) <= 2 else 1 if len(w) <= 5 else 2)  # noqa: B023, E731
            weight[term] = sum(1 - edits(w, term) / min(len(w), len(term)) for w in asked if near(w)) if fuzzy else float(term in asked)
        for i, t in texts.items():
            s = 0.0
            for term, tf in collections.Counter(t).items():
                idf = math.log(1 + (len(texts) - df[term] + 0.5) / (df[term] + 0.5))
                s += weight[term] * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if any(weight[w] for w in t):
                best[i] = max(best[i], boost * s)
    return {i: round(s, 6) for i, s in best.items()}


@pytest.mark.parametrize("fuzzy", [False, True])
@pytest.mark.parametrize("query", ["cash tornado", "Casg, desk cash", "q", "", "!!"])
def test_ranking_equals_plain(spark, tmp_path, query, fuzzy):
    docs = spark.createDataFrame(DOCS, "id long, body string, kind string")
    index = ranking.build_index(docs, ("body", "kind"), str(tmp_path / "i"))
    boosts = {"body": 1.0, "kind": 2.5}
    got = {r["id"]: round(r["relevance"], 6) for r in ranking.ranked(index, query, boosts, fuzzy).collect()}
    assert got == plain_bm25(DOCS, query, boosts, fuzzy)


def test_query_reads_only_its_terms(spark, tmp_path):
    docs = spark.range(2000).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("body"))
    index = ranking.build_index(docs, ("body",), str(tmp_path / "i"))
    hits = ranking.ranked(index, "w77", {"body": 1.0})
    assert [r["id"] for r in hits.collect()] == [77]
    plan = hits._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, body string")
    index = ranking.build_index(docs, ("body",), str(tmp_path / "i"))
    assert ranking.ranked(index, "x", {"body": 1.0}).count() == 0


def test_links_of_groups_grow_with_the_records(spark):
    """Records of one name, of which half have a date of birth and half a number, no two alike: each of one half matches each of the other."""
    n = 200
    k, number = F.col("id"), F.col("id").cast("string")
    attributes = F.when(k % 2 == 0, F.create_map(F.lit("name"), F.lit("Maria Garcia"), F.lit("date_of_birth"), number)).otherwise(F.create_map(F.lit("name"), F.lit("Maria Garcia"), F.lit("national_id"), number))
    records = spark.range(n).select("id", F.lit("crm").alias("source_system"), F.lit("individual").alias("entity_type"), attributes.alias("attributes"))
    found = resolution.matching_pairs(records)
    rows = found.collect()
    assert n - 1 <= len(rows) < 2 * n and all(r["id_a"] % 2 != r["id_b"] % 2 and r["score"] >= 0.75 for r in rows)
    assert {r["cluster"] for r in resolution.clusters(records, found).collect()} == {0}


def test_stars_equal_clusters_of_pairs(spark):
    """The same rows; the plan joins no pairs of ids."""
    rng = random.Random(8)
    names = ["Maria Garcia", "Maria Garzia", "Mario Garcia", "Peter Smith", "Peter Smyth", None, "", "Zoe"]
    people = spark.createDataFrame([(i, rng.choice(names)) for i in range(80)], "id long, name string")
    plain = lambda df: sorted((r["id"], r["matches"], round(r["avg_similarity"], 9), r["match_count"]) for r in df.select("id", "matches", "avg_similarity", "match_count").collect())
    out = resolution.resolve_job(people)
    assert plain(out) == plain(resolution.job_clusters(resolution.job_pairs(people))) and len(plain(out)) > 20
    assert "id_b" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_matches_are_made_last(spark):
    """Entities bring their columns to the names; the lists, which grow with the square of the records a name, meet no join after they are made."""
    people = spark.createDataFrame([(3, "Ana", "x"), (1, "ana.", "y"), (2, "Ana", "z"), (None, "Ana", "w"), (4, None, "v")], "id long, name string, source_system string")
    out = resolution.resolve_job(people)
    assert out.columns == ["id", "matches", "avg_similarity", "match_count", "name", "source_system"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, [2, 3], 1.0, 2, "ana.", "y"), (2, [3], 1.0, 1, "Ana", "z")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index(" AS matches") < plan.index("Join")
