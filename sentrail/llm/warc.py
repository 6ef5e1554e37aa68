"""Not-modified revisits resolved to the full response they stand for.

A revisit (HTTP 304) has no body; it means the latest earlier full response for the
same canonical URL, if the validators agree. That is an as-of join. Captures are
range-partitioned and sorted by (URL, time), so a URL with any share of the captures
is spread over as many tasks as it needs; each task carries the last response along
its rows, and what the first rows of a task lack comes from a small table of each
task's last response. Bodies never travel: the result points to the response.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import tidy

#: Fields of a 304 that do not update the stored response: they describe its own message or connection.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or utm_ parameter; parameters sorted; '/' for no path.

    User information, path and parameters keep their case, percent-encoding and dot segments as they are.
    """
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    base, query = F.regexp_extract(u, r"^([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    head = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    scheme, user = F.regexp_extract(head, r"^([^:]*://)", 1), F.regexp_extract(head, r"://(.*@)", 1)
    head = F.concat(F.lower(scheme), user, F.lower(F.regexp_extract(head, r"([^@/]*)$", 1)))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))), "&")
    return F.concat(head, F.when((path == "") & (head != ""), "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers updated by the permitted ones of the revisit; names in lower case."""

    def low(m: Column) -> Column:
        """Of names that differ in letter case only, the last in order of spelling."""
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        plain = F.size(F.array_distinct(F.transform(F.map_keys(m), lambda k: F.lower(k)))) == F.size(m)
        e = F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct(F.lower(x["key"]).alias("name"), x["key"].alias("key"), x["value"].alias("value"))))
        names = F.array_distinct(F.transform(e, lambda x: x["name"]))
        return F.when(plain, F.transform_keys(m, lambda k, _: F.lower(k))).otherwise(F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(e, lambda x: x["name"] == k), -1)["value"])))

    new = F.map_filter(low(fresh), lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    old = F.map_filter(low(stored), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def validators_agree(etag: Column, old_etag: Column, modified: Column, old_modified: Column, digest: Column, old_digest: Column) -> Column:
    """Entity tags decide where both have one (compared weakly), else dates, else payload digests; null if none is shared."""
    opaque = lambda e: F.regexp_replace(e, "^W/", "")
    return F.coalesce(opaque(etag) == opaque(old_etag), modified == old_modified, digest == old_digest)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``(record_id, url, status, refers_to, headers)`` for each revisit of ``captures``.

    ``captures`` has record_id long, kind ('response' or 'revisit'; others are left
    out), url, ts long, etag, last_modified, digest, and headers map<string,string>; null
    in any of them is allowed. Among responses of one URL and time the greatest id is the
    later. ``status`` is 'resolved', 'mismatch' (validators differ), 'unvalidated' (none in
    common) or 'no_response' (nothing earlier, or no time); ``refers_to`` is the response of
    the first three; ``headers`` are merged for resolved ones, else null. A response without
    an id cannot be referred to and is left out; responses that repeat an id count as the
    latest of them. Repeated revisits give repeated results; of headers whose names differ in
    letter case only, the last spelling counts; an empty table gives no rows; other columns
    are not looked at.
    """
    named = captures.where("kind = 'revisit' or kind = 'response' and record_id is not null").select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", "etag", "last_modified", "digest", "headers")
    placed = named.where("ts is not null").withColumn("late", (F.col("kind") == "response").cast("int"))
    # revisits come before responses of the same time, which are not earlier
    ordered = placed.repartitionByRange("url", "ts", "late", "record_id").sortWithinPartitions("url", "ts", "late", "record_id")

    @tidy
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, url, last, names = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            names = names or batch.schema.names
            keep, refs = [], []
            for i, (r, k, u) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                if u != url:
                    url, last = u, None
                if k == "response":
                    last = r
                else:
                    keep.append(i)
                    refs.append(last)
            rows = [batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 2, 4, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(refs, pa.int64()), pa.array([part] * len(keep), pa.int32()), pa.array([False] * len(keep), pa.bool_())], names=columns)
            kinds = [batch.schema.field(i).type for i in (0, 2, 4, 5, 6, 7)]
        if last is not None:  # what later tasks with this URL go on from
            nulls = [pa.nulls(1, t) for t in kinds]
            nulls[1] = pa.array([url], kinds[1])
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([last], pa.int64()), pa.array([part], pa.int32()), pa.array([True])], names=columns)

    columns = ["record_id", "url", "etag", "last_modified", "digest", "headers", "ref", "part", "tail"]
    carried = materialize(ordered.mapInArrow(carry, "record_id long, url string, etag string, last_modified string, digest string, headers map<string,string>, ref long, part int, tail boolean"), "revisits")
    tails = carried.where("tail").select("url", "part", "ref")  # at most one row for each task
    open_ = carried.where("not tail and ref is null").select("url", "part").distinct().join(tails.select("url").distinct(), "url", "left_semi")
    steps = tails.unionByName(open_.withColumn("ref", F.lit(None).cast("long")))
    before = W.partitionBy("url").orderBy("part").rangeBetween(W.unboundedPreceding, -1)
    earlier = steps.withColumn("before", F.last("ref", ignorenulls=True).over(before)).where("before is not null").groupBy("url", "part").agg(F.max("before").alias("before"))
    found = carried.where("not tail").join(earlier, ["url", "part"], "left").withColumn("ref", F.coalesce("ref", "before")).drop("before", "part", "tail")
    timeless = named.where("kind = 'revisit' and ts is null").select("record_id", "url", "etag", "last_modified", "digest", "headers", F.lit(None).cast("long").alias("ref"))
    old = named.where("kind = 'response' and ts is not null").select(F.col("record_id").alias("ref"), *(F.col(c).alias(f"old_{c}") for c in ("etag", "last_modified", "digest", "headers")), "ts")
    order = F.struct("ts", "old_etag", "old_last_modified", "old_digest", F.to_json("old_headers"))
    old = old.groupBy("ref").agg(F.max_by(F.struct("old_etag", "old_last_modified", "old_digest", "old_headers"), order).alias("o")).select("ref", "o.*")
    # written, and met only by revisits that have a response: a hot one's can then be split, and nulls do not meet in one task
    old = materialize(old, "responses")
    alone = found.where("ref is null").unionByName(timeless)
    both = found.where("ref is not null").join(old, "ref", "left").unionByName(alone, allowMissingColumns=True)
    agree = validators_agree(*(F.col(c) for c in ("etag", "old_etag", "last_modified", "old_last_modified", "digest", "old_digest")))
    status = F.when(F.col("ref").isNull(), "no_response").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    out = both.select("record_id", "url", status.alias("status"), F.col("ref").alias("refers_to"), "headers", "old_headers")
    merged = F.when(F.col("status") == "resolved", merged_headers(F.col("old_headers"), F.col("headers")))
    return out.select("record_id", "url", "status", "refers_to", merged.alias("headers"))


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """A capture log over a table of pages: each page fetched in full, and asked for again later.

    Page p is fetched at 60 p and asked for again 45 seconds after (every 13th 30 seconds
    before) under a variant of its URL. Some responses lack an entity tag or a date; some
    revisits bring another tag, a weak one, or none.
    """
    p, tag, day = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 8), F.lit('"')), F.lit(86400)
    etag = F.when(p % 5 != 0, tag)
    modified = F.when(p % 7 != 0, F.concat(F.lit("t"), (p * 60 - day).cast("string")))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")

    def headers(**kv: Column) -> Column:
        m = F.create_map(*(x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)))
        return F.map_filter(m, lambda _, v: v.isNotNull())

    full = pages.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), (60 * p).alias("ts"), etag.alias("etag"), modified.alias("last_modified"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
        headers(content_type=F.lit("text/html"), content_length=size, cache_control=F.lit("max-age=60"), etag=etag, last_modified=modified).alias("headers"),
    )
    new_tag = F.when(p % 11 == 0, F.lit('"changed"')).when(p % 3 == 0, F.concat(F.lit("W/"), etag)).when(p % 17 != 0, etag)
    new_modified = F.when(p % 4 != 0, modified)
    again = pages.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.when(p % 2 == 0, "#again").otherwise("")).alias("url"), (60 * p + F.when(p % 13 == 0, -30).otherwise(45)).alias("ts"), new_tag.alias("etag"), new_modified.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        headers(content_length=F.lit("0"), cache_control=F.concat(F.lit("max-age="), (p % 100).cast("string")), date=F.concat(F.lit("t"), (60 * p).cast("string")), etag=new_tag).alias("headers"),
    )
    return full.unionByName(again)
