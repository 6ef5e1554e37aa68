"""Paged REST endpoints as a data source: pages are read in parallel and filters travel with the request.

The endpoint answers ``url?page=N&size=S`` (pages from 1) with ``{"total": rows, "items": [objects]}``. With ``since``, a
column and a time, only rows from then on are asked for. Register with ``register(spark)`` and read by
``spark.read.format("paged_rest")``.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StructType, TimestampType

#: What a filter is called in a request: column__gte=value.
REQUESTS = {EqualTo: "", GreaterThan: "__gt", GreaterThanOrEqual: "__gte", LessThan: "__lt", LessThanOrEqual: "__lte"}


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        raise ValueError("name the schema of a paged_rest source")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.fields = options["url"], schema.fields
        self.size, self.parts = int(options.get("size", 1000)), int(options.get("parts", 8))
        self.most = int(options["limit"]) if "limit" in options else None
        self.asked = [(options["sinceColumn"] + "__gte", options["since"])] if "since" in options else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of plain columns go into the request; the rest, and all with a limit, stay with Spark."""
        for f in filters:
            if type(f) in REQUESTS and len(f.attribute) == 1 and self.most is None and isinstance(f.value, (str, int, float, bool)):
                self.asked.append((f.attribute[0] + REQUESTS[type(f)], json.dumps(f.value) if isinstance(f.value, bool) else f.value))
            else:
                yield f

    def get(self, page: int) -> dict:
        query = urllib.parse.urlencode([("page", page), ("size", self.size), *self.asked])
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=60) as answer:
            return json.load(answer)

    def partitions(self) -> list[Pages]:
        total = self.get(1)["total"]
        total = total if self.most is None else min(total, self.most)
        pages = -(-total // self.size)
        step = max(1, -(-pages // self.parts))
        return [Pages(p, min(p + step - 1, pages)) for p in range(1, pages + 1, step)] or [Pages(1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            items = self.get(page)["items"]
            if self.most is not None:
                items = items[: self.most - (page - 1) * self.size]
            for item in items:
                yield tuple(self.value(item.get(f.name), f.dataType) for f in self.fields)

    @staticmethod
    def value(v: object, kind: object) -> object:
        if v is None:
            return None
        if isinstance(kind, TimestampType):
            return datetime.fromisoformat(str(v))
        return datetime.fromisoformat(str(v)).date() if isinstance(kind, DateType) else v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def paged(spark: SparkSession, url: str, schema: str, size: int = 1000, parts: int = 8, limit: int | None = None, lookback_days: int | None = None, at: str = "transaction_date", now: datetime | None = None) -> DataFrame:
    """The rows behind ``url``; with ``lookback_days`` those whose ``at`` is not older, with ``limit`` the first so many as the endpoint has them."""
    register(spark)
    options = {"url": url, "size": size, "parts": parts}
    if limit is not None:
        options["limit"] = limit
    if lookback_days is not None:
        options |= {"sinceColumn": at, "since": ((now or datetime.now()) - timedelta(days=lookback_days)).isoformat()}
    return spark.read.format("paged_rest").schema(schema).options(**options).load()
