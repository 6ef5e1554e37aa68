"""Each operation against a brute-force version, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sentrail.llm import bpe, decontaminate, exact_dedup, packing, queries, sharding, simhash, substring, token_count, toxicity, url_filter, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "word " * 60), (6, "word " * 60), (6, "word " * 60), (7, "two words"), (8, "Ünïcode — ß 日本"), (None, "no id here"), (9, "long " * 30000)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    return docs_of(spark, AWKWARD).withColumns({"doc": F.lit("clash"), "t": F.lit(1), "fp": F.lit(2), "n": F.lit(3), "sha256": F.lit("c"), "size": F.lit(0), "told": F.lit(0), "rank": F.lit(5)})


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# 1 ---------------------------------------------------------------------------


def test_shards_fit_and_only_large_buckets_split(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7 * 10 + 5).alias("b"))
    out = sharding.assign_shards(df, "k", F.col("b"), 2000).toPandas()
    assert len(out) == 3000 and out.n_bytes.sum() == df.agg(F.sum("b")).first()[0]
    size = out.groupby("shard").n_bytes.sum()
    assert (size <= 2000).all()
    shards = set(size.index)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)  # a partition of the addresses
    for s in shards:  # the parent was over the limit
        assert not s or out[out.shard.str.startswith(s[:-1])].n_bytes.sum() > 2000


def test_shards_of_one_hot_key_and_of_repeated_rows(spark):
    df = spark.range(1200).select(F.when(F.col("id") < 600, F.lit(1)).otherwise(F.col("id")).alias("k"), F.lit(10).alias("b"))
    out = sharding.assign_shards(df, "k", F.col("b"), 500).toPandas()
    assert len(out) == 1200 and (out.groupby("shard").n_bytes.sum() <= 500).all()
    same = spark.createDataFrame([(None, 10)] * 50 + [(1, None)] * 3 + [(2, 10_000)], "k long, b long")
    out = sharding.assign_shards(same, "k", F.col("b"), 100).toPandas()
    assert len(out) == 54
    size = out.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((size["sum"] <= 100) | (size["count"] == 1)).all()


def test_shards_edges(spark, awkward, none, tmp_path):
    size = F.octet_length("text")
    assert sharding.assign_shards(awkward, "doc_id", size, 1 << 20).count() == len(AWKWARD)
    assert sharding.assign_shards(none, "doc_id", size, 10).count() == 0
    df = docs_of(spark, [(i, "x" * 100) for i in range(64)])
    shards = sharding.write_shards(df, "doc_id", size, 800, str(tmp_path / "s"))
    named = df.withColumns({"shard": F.lit("mine"), "shard_bytes": F.lit(7), "__key": F.lit(8)})
    sharding.write_shards(named, "doc_id", size, 800, str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    assert set(named.columns) < set(kept.columns) and kept.where("shard = 'mine' and shard_bytes = 7 and __key = 8").count() == 64
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 64 and back.select("shard").distinct().count() == shards.count() > 4


# 2 ---------------------------------------------------------------------------


def edit_in(item, text, whole=False):
    """Least edits of item anywhere in text, or (``whole``) from one edge of a word to another."""
    inside = [False, *(c.isalnum() or c == "_" for c in text), False]
    edge = [not whole or not (x and y) for x, y in zip(inside, inside[1:], strict=False)]
    col = [0 if e else 999 for e in edge]
    for i, c in enumerate(item, 1):
        new = [col[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(col[j - 1] + (c != d), col[j] + 1, new[j - 1] + 1))
        col = new
    return min(x for x, e in zip(col, edge, strict=True) if e)


def squeeze(t):
    return re.sub(r"\s+", " ", (t or "").lower()).strip()


@pytest.mark.parametrize("whole,kind", [(False, "long"), (True, "long"), (True, "string")])
def test_leaks_equal_brute_force(spark, monkeypatch, whole, kind):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)  # several blocks in a pass, and several passes
    monkeypatch.setattr(decontaminate, "BLOCKS", 3)
    r = random.Random(3)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(6, 30)))) for i in range(12)] + [(90, "eta mu"), (91, None), (92, ""), (93, "xi omicron pi"), (94, "a"), (95, "tau upsilon delta rho"), (96, "pha bet")]
    rows = []
    for i in range(60):
        text = " ".join(r.choices(WORDS, k=r.randint(0, 60)))
        if i % 3 == 0:
            t = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, 9)):
                p = r.randrange(len(t))
                t[p : p + r.randint(0, 1)] = r.choice("abcxyz ")
            text += " " + "".join(t).upper() + "\n" + " ".join(r.choices(WORDS, k=9))
        rows.append((i, text))
    rows += [(60 + i, f"zz {t} zz") for i, t in enumerate(["tau upsilon delta rho", "tau upsilon delta rhox", "tau upsilom delta rho", "xtau upsilon delta rho", "alpha beta"])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    found = decontaminate.find_leaks(docs_of(spark, rows), bench, whole_words=whole)
    assert found.schema["item"].dataType == bench.schema["item_id"].dataType
    got = {(x["doc"], int(x["item"])): x["edits"] for x in found.orderBy(F.desc("edits")).collect()}
    want = {}
    for i, t in rows:
        for j, item in items:
            item = squeeze(item)
            if item:
                e = edit_in(item, squeeze(t), whole)
                if e <= int(decontaminate.ERROR_RATE * len(item)):
                    want[i, j] = e
    assert got == want and len(want) > 8 and {90, 95} <= {j for _, j in want} and ((64, 96) in want) is not whole
    clean = {x["doc_id"] for x in decontaminate.without_leaks(docs_of(spark, rows), bench, whole_words=whole).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_items_of_one_length_follow_one_rule():
    ks = [decontaminate.edit_budget(m, 0.05)[0] for m in range(1, 60)]
    assert ks == [int(0.05 * m) for m in range(1, 60)]
    assert all(decontaminate.edit_budget(m, 0.05)[2] >= 1 for m in range(1, 60))


def test_alignment_is_given_up_beyond_its_budget():
    """An item of 3000 characters in a place that is not alike costs less than half of one that is, with the same result."""
    rng = np.random.default_rng(1)
    item, other = rng.integers(97, 123, 3000).astype(np.uint32), rng.integers(97, 123, 3300).astype(np.uint32)
    alike = np.concatenate([other[:150], item, other[:150]])
    alike[1000] = 32

    def seconds(region):
        took = []
        for _ in range(3):
            began = time.process_time()
            found = decontaminate.banded(item, region, 150)
            took.append(time.process_time() - began)
        return found, min(took)

    found, long = seconds(alike)
    none, short = seconds(other)
    assert found == (1, 150, 3150) and none is None and short < long / 2


def test_leaks_of_the_table_equal_brute_force(spark, sf):
    docs = {i: squeeze(t) for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    items = {i: squeeze(t) for i, t in duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()}
    want = {}
    for j, x in items.items():
        grams = {x[k : k + 12] for k in range(0, len(x) - 12, 12)}
        for i, t in docs.items():
            if sum(g in t for g in grams) >= min(2, len(grams)):  # with an edit for each 20 characters, some of the grams of 12 stay whole
                e = edit_in(x, t)
                if e <= int(decontaminate.ERROR_RATE * len(x)):
                    want[i, j] = e
    got = {}
    for r in queries.op2_decontaminate(spark, sf).collect():
        got[r["doc_id"], r["item_id"]] = min(r["edits"], got.get((r["doc_id"], r["item_id"]), 99))
    assert got == want and want


def test_leaks_edges(spark, awkward, none):
    bench = spark.createDataFrame([(1, "word " * 20), (1, "word " * 20), (2, "nothing like it in any text here")], "item_id long, text string")
    out = decontaminate.find_leaks(awkward, bench).toPandas()
    assert set(out.doc) == {5, 6} and (out.edits == 0).all()
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(awkward, bench.limit(0)).count() == 0
    named = awkward.withColumn("__normalized", F.lit("x"))
    assert decontaminate.without_leaks(named, bench).columns == named.columns and decontaminate.without_leaks(named, bench).count() == len(AWKWARD) - 3
    again = decontaminate.find_leaks(docs_of(spark, [(1, "of the word " * 100 + "wo")]), spark.createDataFrame([(7, "of the"), (8, "word of the word of the word")], "item_id long, text string")).toPandas()
    assert (again.item == 7).sum() == 100 and (again.item == 8).sum() == 33  # places of one item do not overlap
    kept = decontaminate.without_leaks(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3


# 3 ---------------------------------------------------------------------------


def test_counts_equal_the_library(spark, sf, awkward, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    r = random.Random(5)
    odd = [*"aA bΣéÉß'’s\x1c\x1f\x85\xa0\u3000\u200b0\u0661日本😀\n_İŉǅẞ½", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "the", "\r\n", "\ufffd"]
    mine = bpe.WordBpe(path)
    ids = packing.WordIds(path)
    for _ in range(1500):
        s = "".join(r.choice(odd) for _ in range(r.randint(0, 12)))
        want = tok.encode(s, add_special_tokens=False).ids
        assert mine.count(s) == len(want) and ids.encode(s) == struct.pack(f"<{len(want)}I", *want), repr(s)
    every = [f"a{c}b {c} {c}{c}1" for c in map(chr, range(1, 0x2FA20)) if not 0xD800 <= ord(c) <= 0xDFFF]
    for s, e in zip(every, tok.encode_batch(every, add_special_tokens=False), strict=True):
        assert mine.count(s) == len(e.ids) and ids.encode(s) == struct.pack(f"<{len(e.ids)}I", *e.ids), repr(s)
    new = "".join(chr(c) for c in range(0x370, 0x1FFFF, 13) if not 0xD800 <= c <= 0xDFFF) + "\x1c\u0558a"
    assert mine.count(new) == len(tok.encode(new, add_special_tokens=False).ids)
    got = queries.op3_token_counts(spark, sf).toPandas()
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == want
    assert (got.over_limit == (got.n_tokens > 2048)).all()
    out = token_count.count_tokens(awkward, path).toPandas()
    assert len(out) == len(AWKWARD) and out[out.doc == 1].n_tokens.item() == 0 and out[out.doc == 9].n_tokens.item() == 30000
    assert token_count.count_tokens(none, path).count() == 0


# 4 ---------------------------------------------------------------------------


def url_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_url_score(model, host, path):
    """One URL's score, n-gram by n-gram."""
    z = []
    for salt, part in ((1, host), (2, path)):
        raw = part.encode()
        for n in url_filter.NGRAMS:
            for i in range(len(raw) - n + 1):
                h = salt * 8 + n
                for b in raw[i : i + n]:
                    h = (h * 0x100000001B3 + b + 1) % 2**64
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ h >> shift) * by % 2**64
                z.append(model.w[(h ^ h >> 31) >> 64 - url_filter.HASH_BITS])
    return 1 / (1 + math.exp(-model.b - sum(z) / max(1, len(z)) ** 0.5))


def test_url_filter_equals_brute_force(spark, sf):
    model = url_filter.train(spark.createDataFrame(url_filter.labelled_urls(), "url string, unwanted int"))
    got = {r["page_id"]: r for r in queries.op4_url_filter(spark, sf).collect()}
    rules = sorted(queries.URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rows = duckdb.sql(f"select page_id, url from '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, url in rows:
        host, path = url_parts(url)
        rule = next(((v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)
        score = plain_url_score(model, host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1])
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        assert got[i]["verdict"] == (rule[0] if rule else "block" if score >= 0.5 else "allow")


def test_url_model_on_held_out_rows_and_on_pages():
    def model(rows):
        h, p = zip(*[url_parts(u) for u, _ in rows], strict=True)
        return url_filter.UrlModel().fit(pa.array(h), pa.array(p), np.array([y for _, y in rows], float))

    def blocked(m, urls):
        h, p = zip(*map(url_parts, urls), strict=True)
        return m.score(pa.array(h), pa.array(p)) >= 0.5

    rows = url_filter.labelled_urls()
    right = 0
    for k in range(5):
        test = rows[k::5]
        right += sum(blocked(model([r for i, r in enumerate(rows) if i % 5 != k]), [u for u, _ in test]) == [y == 1 for _, y in test])
    assert right / len(rows) > 0.85
    start = 0
    for urls in url_filter.WANTED.values():  # kinds of hosts that the model has not seen
        at, start = range(start, start + len(urls)), start + len(urls)
        assert blocked(model([r for i, r in enumerate(rows) if i not in at]), urls).mean() <= 0.2
    pages = [u for (u,) in duckdb.sql("select url from '/root/testdata/sf0.1/pages.parquet' where url is not null").fetchall()]
    bad = np.array([bool(re.search("casino|bets|ads-|spam|pills|adult", url_parts(u)[0])) for u in pages])
    got = blocked(model(rows), pages)
    assert got[bad].mean() > 0.9 and got[~bad].mean() < 0.06


def test_of_rules_of_one_length_the_first_wins(spark):
    model = url_filter.UrlModel().fit(pa.array(["a", "b"]), pa.array(["/", "/"]), np.array([0.0, 1.0]))
    pages = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    for first, second in (("allow", "block"), ("block", "allow")):
        assert url_filter.judge(pages, model, [(first, "org", "/a"), (second, "org", "/a")]).first()["verdict"] == first


def test_url_edges(spark):
    model = url_filter.train(spark.createDataFrame(url_filter.labelled_urls(), "url string, unwanted int"))
    rows = [(1, None), (2, ""), (3, "no scheme/path"), (4, "HTTP://A.ORG"), (5, "x://org/"), (5, "x://org/"), (6, "a://b://c/d"), (7, "http://É.Example.Org/en/1?x#y"), (None, "http://notorg/?q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {(r["page"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(pages, model, queries.URL_RULES).collect()}
    assert out[5, "org", "/"] == ("org/", "allow")
    assert out[7, "É.example.org", "/en/1"] == ("example.org/en/1", "block")
    assert {(1, "", ""), (2, "", ""), (3, "", ""), (4, "a.org", ""), (6, "b:", "//c/d"), (None, "notorg", "/")} <= set(out)
    assert url_filter.judge(pages.limit(0), model).count() == 0


# 5 ---------------------------------------------------------------------------


def check_packing(rows, texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc"]].append(r)
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 4096))
        for p in pieces:
            part = ids[p["start"] : p["start"] + 4096]
            assert p["length"] == len(part) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return len(seqs)


def test_packing_is_exact_and_tight(spark, sf):
    path = queries.tokenizer_path()
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), path).collect()
    n = check_packing(rows, duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall(), path)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_edges(spark, none):
    path = queries.tokenizer_path()
    rows = [(i, t) for i, t in AWKWARD if i not in (6, None)]
    got = packing.pack(docs_of(spark, rows), path).collect()
    check_packing(got, rows, path)
    assert packing.pack(none, path).count() == 0
    assert packing.pack(docs_of(spark, AWKWARD), path).count() == len(AWKWARD) + 7  # 30001 ids are eight pieces


@pytest.mark.parametrize("caps", [{}, {"pieces": 3}, {"cost": 4096 * 4096}])
def test_best_fit_keeps_every_capacity(caps):
    r = np.random.default_rng(2)
    lengths = np.minimum(4096, np.maximum(1, r.lognormal(5.5, 1.5, 20000).astype(int)))
    values, counts = np.unique(lengths, return_counts=True)
    placed, n = packing.best_fit([(int(v), int(c)) for v, c in zip(values, counts, strict=True)], **caps)
    tokens, pieces, cost = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for length, _, count, first, each, _ in placed:
        s = first + np.arange(count) // each
        for total, add in ((tokens, length), (pieces, 1), (cost, length * length)):
            np.add.at(total, s, add)
    assert pieces.sum() == len(lengths) and tokens.max() <= 4096
    assert pieces.max() <= caps.get("pieces", 4096) and cost.max() <= caps.get("cost", 4096**2) and pieces.min() > 0
    if not caps:
        assert n <= 1.002 * lengths.sum() / 4096 + 1


def test_best_fit_under_binding_capacities():
    r = np.random.default_rng(3)
    lengths = np.minimum(1000, np.maximum(1, r.lognormal(4, 1.2, 5000).astype(int)))
    values, counts = np.unique(lengths, return_counts=True)
    caps = {"pieces": 12, "cost": 1_500_000}
    placed, n = packing.best_fit([(int(v), int(c)) for v, c in zip(values, counts, strict=True)], **caps)
    total = np.zeros((3, n), int)
    for length, _, count, first, each, _ in placed:
        s = first + np.arange(count) // each
        for k, x in enumerate((length, 1, length * length)):
            np.add.at(total[k], s, x)
    assert total[1].sum() == len(lengths) and (total.max(1) <= (4096, 12, 1_500_000)).all()
    least = max(-(-len(lengths) // 12), -(-int((lengths**2).sum()) // 1_500_000), -(-int(lengths.sum()) // 4096))
    assert n <= 1.1 * least + 1


# 6 ---------------------------------------------------------------------------


def test_exact_groups(spark, awkward, none):
    rows = [(5, "a b"), (3, "a \n b"), (9, "a b "), (1, ""), (2, None), (7, "c"), (7, "c"), (8, "c"), (None, "c")]
    got = {(r["doc"], r["keep"], r["group_size"]) for r in exact_dedup.exact_groups(docs_of(spark, rows)).collect()}
    assert got == {(5, 3, 2), (3, 3, 2), (9, 9, 1), (1, 1, 2), (2, 1, 2), (7, 7, 4), (8, 7, 4), (None, 7, 4)}
    kept = [(r["doc"], r["sha256"]) for r in exact_dedup.exact_groups(docs_of(spark, rows), digest_all=True).where("kept").collect()]
    assert sorted(d for d, _ in kept) == [1, 3, 7, 9] and dict(kept)[3] == hashlib.sha256(b"a b").hexdigest()
    out = exact_dedup.drop_duplicates(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 7, 9] and out.columns == docs_of(spark, rows).columns
    mixed = [(1, "x"), (1, "y"), (2, "x"), (0, "y")]
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs_of(spark, mixed)).collect()) == [(0, "y"), (1, "x")]
    named = docs_of(spark, mixed).withColumns({"__sha": F.lit("s"), "__k0": F.lit(1), "doc": F.lit(2), "len": F.lit(3), "live": F.lit(4)})
    assert exact_dedup.drop_duplicates(named).columns == named.columns and exact_dedup.drop_duplicates(named).count() == 2
    unique = exact_dedup.drop_duplicates(docs_of(spark, [(1, "x"), (2, "x"), (3, "z")]))
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3]
    assert exact_dedup.exact_groups(awkward).count() == len(AWKWARD)
    assert exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_of_several_null_ids(spark):
    rows = [(5, "x"), (None, "x"), (None, "unique"), (7, "z")]
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, "x"), (None, "unique"), (7, "z")], key=str)


# 7 ---------------------------------------------------------------------------


def test_toxicity_finds_held_out_insults(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.withColumnRenamed("doc_id", "doc"), "doc").where("held_out").toPandas()
    assert len(out) > 1000 and all(out.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out.doc])
    hit = out[out.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95 and out[out.toxic == 1].predicted.mean() > 0.9
    assert (out.predicted == (out.score >= 0.7)).all() and out.score.between(0, 1).all()


def test_toxicity_scores_equal_plain_ones(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in queries.op7_toxicity(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        known = sorted({w for w in re.findall(r"\w+", (t or "").lower()) if w in m.words})
        z = m.bias + sum(m.words[w] for w in known) / math.sqrt(max(1, len(known)))
        for vote, weight in zip(m.voters.vote(toxicity.facts(t or "")), m.vote_weights, strict=True):
            z += weight * {toxicity.TOXIC: 1, toxicity.CLEAN: -1, toxicity.NONE: 0}[int(vote)]
        held, score, predicted = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and predicted == (score >= 0.7)


def test_toxicity_edges(spark, awkward, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(none, labels)
    out = toxicity.score(awkward, model).toPandas()
    assert len(out) == len(AWKWARD) and out.score.between(0, 1).all() and not out.predicted.any()
    assert model.score("you idiot, you stupid clown") > 0.7 > model.score("a fine day")
    assert toxicity.score(none, model).count() == 0
    assert toxicity.without_toxic(docs_of(spark, [(1, "you idiot, you stupid clown"), (2, None), (3, "fine")]), model).count() == 2


def test_label_model_learns_accuracy_and_discounts_copies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    good = np.where(r.random(4000) < 0.92, y, ~y).astype(np.int8)
    poor = np.where(r.random(4000) < 0.6, y, ~y).astype(np.int8)
    votes = np.stack([good, np.where(r.random(4000) < 0.9, y, ~y).astype(np.int8), poor, poor, poor], 1)
    m = toxicity.LabelModel(prior=0.3).fit(votes, np.full(5, 0.7))
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85
    assert m.weights[2] < 0.6 < m.weights[0]


# 8 ---------------------------------------------------------------------------

CAPTURES = "record_id long, kind string, url string, ts long, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark):
    h = {"Content-Type": "text/html", "X": "old", "Content-Length": "9"}
    rows = [
        (1, "response", "HTTP://A.com:80", 10, '"v1"', None, "d1", h), (2, "response", "http://a.com/?utm_source=x", 20, '"v2"', "lm", "d2", h),
        (3, "revisit", "http://a.com/#f", 15, 'W/"v1"', None, None, {"x": "new", "content-length": "0"}), (4, "revisit", "http://a.com/", 20, '"v1"', None, None, None),
        (5, "revisit", "http://a.com/", 21, '"v1"', None, None, {}), (6, "revisit", "http://a.com/", 22, None, None, "d2", {}), (7, "revisit", "http://a.com/", 23, None, "x", None, {}),
        (8, "revisit", "http://b.com/", 30, None, None, None, {}), (9, "revisit", "http://a.com/", None, None, None, None, {}), (10, "request", "http://a.com/", 11, None, None, None, {}),
        (11, "revisit", None, 5, None, None, None, None), (12, "revisit", "http://a.com/", 24, None, None, None, {}),
    ]
    out = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {k: (r["status"], r["refers_to"]) for k, r in out.items()} == {
        3: ("resolved", 1), 4: ("resolved", 1), 5: ("mismatch", 2), 6: ("resolved", 2), 7: ("mismatch", 2), 8: ("no_response", None), 9: ("no_response", None), 11: ("no_response", None), 12: ("unvalidated", 2),
    }
    assert out[3]["headers"] == {"content-type": "text/html", "x": "new", "content-length": "9"} and out[5]["headers"] is None
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_awkward_revisits(spark):
    rows = [
        (1, "response", "http://Bob:Secret@A.com/x", 10, '"v"', None, None, {"ETag": '"v"', "etag": '"w"', "X": "1"}), (None, "response", "http://Bob:Secret@a.com/x", 20, '"z"', None, None, {}),
        (2, "revisit", "HTTP://Bob:Secret@a.COM/x", 30, '"v"', None, None, {"x": "2", "X": "3"}), (2, "revisit", "HTTP://Bob:Secret@a.COM/x", 30, '"v"', None, None, {"x": "2", "X": "3"}),
        (3, "revisit", "http://bob:secret@a.com/x", 30, '"v"', None, None, {}), (7, "response", "http://t.com/", 1, '"a"', None, None, {"h": "1"}), (7, "response", "http://t.com/", 2, '"b"', None, None, {"h": "2"}),
        (8, "revisit", "http://t.com/", 5, '"b"', None, None, None), (None, "revisit", "http://t.com/", 6, '"b"', None, None, None),
    ]
    out = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()
    got = collections.Counter((r["record_id"], r["status"], r["refers_to"]) for r in out)
    assert got == {(2, "resolved", 1): 2, (3, "no_response", None): 1, (8, "resolved", 7): 1, (None, "resolved", 7): 1}
    assert next(r["headers"] for r in out if r["record_id"] == 2) == {"etag": '"w"', "x": "2"}
    assert next(r["headers"] for r in out if r["record_id"] == 8) == {"h": "2"}


def test_revisits_of_one_hot_url_over_many_tasks(spark):
    r = random.Random(1)
    rows = [(i, "response" if r.random() < 0.02 else "revisit", "http://hot.com/", r.randrange(3000), '"e"', None, None, None) for i in range(3000)]
    rows += [(5000 + i, r.choice(["response", "revisit"]), f"http://h{i % 40}.com/", r.randrange(100), '"e"', None, None, None) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["record_id"]: x["refers_to"] for x in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, kind, url, ts, *_ in rows:
        if kind == "revisit":
            before = [(t, j) for j, k, u, t, *_ in rows if k == "response" and u == url and t < ts]
            assert got[i] == (max(before)[1] if before else None)


# 9 ---------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def brute_components(fps):
    """{id: least id reachable} from [(id, fingerprint)]."""
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


def test_simhash_equals_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    comp = brute_components(fps)
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps}


def test_links_of_chains_and_clusters(spark):
    r = random.Random(4)
    fps = [0, 1, 3, 7, 15, 31, 1 << 63, (1 << 64) - 1]
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):  # a chain of small steps
            fps.append(x)
            for _ in range(r.choice((1, 2, 2, 3))):
                x ^= 1 << r.randrange(64)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "doc long, fp long")
    from sentrail.operators.components import connected_components

    comp = {x["id"]: x["component"] for x in connected_components(simhash.links(df)).collect()}
    want = brute_components(list(enumerate(fps)))
    for i, f in signed:
        for j, g in signed[:i]:
            assert (want[i] == want[j]) == (comp.get(f, f) == comp.get(g, g)), (i, j)


def test_simhash_edges(spark, awkward, none):
    got = simhash.near_groups(awkward).toPandas()
    assert len(got) == len(AWKWARD)
    by = {d: c for d, c in zip(got.doc, got.component, strict=True)}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5
    assert simhash.near_groups(none).count() == 0
    kept = simhash.drop_near_duplicates(docs_of(spark, [(1, "a"), (2, "a"), (3, "b c d e f")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("module", ["simhash", "near_dedup"])
def test_near_dedup_of_repeated_and_null_ids(spark, module):
    from sentrail.llm import near_dedup

    drop = {"simhash": simhash, "near_dedup": near_dedup}[module].drop_near_duplicates
    a, near_a, b = " ".join(WORDS), " ".join(WORDS).upper(), " ".join(WORDS[::-1])
    rows = [(1, a), (2, near_a), (2, b), (None, a), (None, "p q r"), (None, "P q r"), (None, "P Q R"), (3, "s t u"), (3, "s t u"), (4, None)]
    got = [(r["doc_id"], r["text"]) for r in drop(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, "P Q R"), (3, "s t u"), (4, None)], key=str)


# 10 --------------------------------------------------------------------------


def brute_repeats(rows, n=20):
    """{id: (words, removed, kept text)} for rows of distinct ids."""
    first, words, out = {}, {}, {}
    for i, t in sorted(rows):
        words[i] = (t or "").encode().split()
        for s in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][s : s + n]), (i, s))
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (i, s):
                gone |= set(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force_on_the_table(spark, sf):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op10_substring(spark, sf).collect()}
    assert got == brute_repeats(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("n", [2, 5, 20])
def test_repeats_of_planted_passages(spark, n):
    r = random.Random(n)
    passages = [" ".join(r.choices(WORDS, k=k)) for k in (19, 20, 21, 40, 90)]
    rows = [(i, None if i == 7 else r.choice((" ", "\n", "\t ")).join(r.choices([*WORDS, *passages], k=r.randint(0, 40)))) for i in range(80)]
    rows += [(200 + i, "same " * (15 + i)) for i in range(8)]
    got = {x["doc"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.remove_repeats(docs_of(spark, rows), words=n).collect()}
    assert got == brute_repeats(rows, n)


def test_repeats_edges(spark, awkward, none):
    out = substring.remove_repeats(awkward).toPandas()
    assert len(out) == len(AWKWARD)
    assert set(out[out.doc == 6].n_removed) == {60} and set(out[out.doc == 5].n_removed) == {59 - 19 + 19}
    assert substring.remove_repeats(none).count() == 0
    two = docs_of(spark, [(1, " ".join(WORDS)), (1, " ".join(WORDS) + " more"), (None, " ".join(WORDS))])
    assert sorted(substring.remove_repeats(two).toPandas().n_removed) == [0, 20, 20]
    most = docs_of(spark, [((1 << 63) - 1, " ".join(WORDS)), (None, " ".join(WORDS)), (None, " ".join(WORDS) + " more"), (-5, "x")])
    assert {(r["doc"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(most).collect()} == {((1 << 63) - 1, 20, 0), (None, 20, 20), (None, 21, 20), (-5, 1, 0)}
    with pytest.raises(ValueError):
        substring.remove_repeats(two.withColumn("doc_id", F.lit("a")))
    assert substring.longest(docs_of(spark, [(1, "w%d " * 50 % tuple(range(50))), (2, "w%d " * 50 % tuple(range(50))), (3, "x")])) == [(20, 1), (40, 1)]


# pipeline --------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    docs = [(i, t) for i, t in docs if model.score(t or "") < 0.7]
    first = {}
    for i, t in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    docs = [(i, t) for i, t in docs if i in set(first.values())]
    docs = brute_near(sorted(docs))
    items = [squeeze(t) for (t,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    grams = [{t[k : k + 12] for k in range(0, len(t) - 12, 12)} for t in items]
    keep = []
    for i, t in docs:
        s = squeeze(t)
        near = [x for x, g in zip(items, grams, strict=True) if sum(a in s for a in g) >= 2]
        if not any(edit_in(x, s) <= int(decontaminate.ERROR_RATE * len(x)) for x in near):
            keep.append((i, t))
    rows = [r.asDict() | {"doc": r["doc_id"]} for r in corpus_pipeline.run(spark, sf).collect()]
    assert {r["doc"] for r in rows} == {i for i, _ in keep}
    check_packing(rows, keep, queries.tokenizer_path())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    leak = "the capital of the invented land is a town by the name of quillon on the river"
    bench = spark.createDataFrame([(1, leak), (2, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 0, 1), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for df, name in ((bench, "benchmark"), (labels, "labels")):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \t"), (None, base), (4, base), (4, base.replace("w30", "other")), (None, "lone text"), (6, "x " + leak + " y"), (6, "another text of id six"),
        (7, "long " * 20000), (8, "you idiot, you stupid clown"), (9, "you moron and loser, you pathetic clown"),
    ]
    docs = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("__key", "__row", "__sha", "__normalized", "__k0", "doc", "t", "key", "n", "root", "size", "label", "kept", "part")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert len(docs.columns) == 19
    kept = sorted(((r["doc_id"], (r["text"] or "")[:12]) for r in docs.collect()), key=str)
    # of the blank texts and of the copies the least id stays; a null id comes last
    assert kept == sorted([(1, ""), (4, "w0 w1 w2 w3 "), (None, "lone text"), (6, "another text"), (7, "long long lo")], key=str)
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).toPandas()
    assert packed["length"].sum() == 20001 + sum(len(queries.packing.encoder(queries.tokenizer_path()).encode(t)) // 4 + 1 for t in (r["text"] or "" for r in docs.collect() if r["doc_id"] != 7))


# near copies -----------------------------------------------------------------


def brute_near(rows):
    """[(id, text)] that stay of [(id, text)] of distinct ids: components of 5-word-shingle Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w)} if 0 < len(w) <= 5 else {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n in range(len(rows)):
        for m in range(n):
            both = len(sets[n] & sets[m])
            if sets[n] == sets[m] or 5 * both >= 4 * (len(sets[n]) + len(sets[m]) - both):
                x, y = root(n), root(m)
                parent[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if root(k) == k]


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return words


def test_near_copies_equal_brute_force(spark, none):
    from sentrail.llm import near_dedup

    r = random.Random(6)
    line = " ".join(r.choices(WORDS, k=12))
    texts = [None, "", " \n", "one", "One", "two words"]
    for n in (8, 40, 120, 400):
        base = r.choices(WORDS, k=n)
        texts += [" ".join(base)] + [" ".join(edited(r, base, k)) for k in range(1, 14)]
        step = base
        for _ in range(6):  # a chain whose ends are far apart
            step = edited(r, step, max(1, n // 60))
            texts.append(" ".join(step))
    texts += [line + " " + " ".join(r.choices(WORDS, k=r.randint(0, 30))) for _ in range(40)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_near(rows)
    for common, hot in ((2, 1), (near_dedup.COMMON, near_dedup.HOT)):
        told, (near_dedup.COMMON, near_dedup.HOT) = (near_dedup.COMMON, near_dedup.HOT), (common, hot)
        got = sorted(x["doc_id"] for x in near_dedup.drop_near_duplicates(docs_of(spark, rows)).collect())
        near_dedup.COMMON, near_dedup.HOT = told
        assert got == [i for i, _ in want] and len(want) < len(rows) - 20
    assert near_dedup.drop_near_duplicates(none).count() == 0


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((x["doc_id"], x["text"]) for x in docs.collect())
    got = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.01")
    assert sorted(x["doc_id"] for x in got.collect()) == [i for i, _ in brute_near(rows)] and got.columns == docs.columns
