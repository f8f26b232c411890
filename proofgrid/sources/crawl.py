"""Paged collections as a Python data source, batch and stream: pages overlap by one item, so that a list that moves under the reader is noticed.

    source = crawl.source(transport)                       # transport(path, {"limit": n, "offset": k}) -> Response
    spark.dataSource.register(source)
    rows = spark.read.format("crawl").option("paths", "matches\\nplayers").option("limit", 100).load()
    crawl.items(rows); crawl.verdicts(rows, "$.id")

A body is a JSON object with the number of all items and a list of those asked for. The driver asks each path for its number only; tasks read
ranges of places, so a path of very many items is spread. The transport is the caller's, so nothing here opens a connection.
"""

from __future__ import annotations

import email.utils
import json
import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, place long, total long, own boolean, item string"
JSON_TYPE = re.compile(r"application/(?:[a-z0-9.+-]+\+)?json\s*(?:;|$)", re.IGNORECASE)
#: Statuses that are asked again, and how often at most.
AGAIN = (429, 503)
MOST_RETRIES = 5


class Response(NamedTuple):
    status: int
    headers: Mapping[str, str]
    body: bytes


Transport = Callable[[str, Mapping[str, int]], Response]


class CrawlError(RuntimeError):
    """A request that failed for good; it says after how many attempts and with what status."""


@dataclass(frozen=True)
class Asking:
    """How a transport is used. paths: of the collections; limit: items a page; pages: of one task; retries; pauses in seconds: backoff (doubled each time) and delay between requests."""

    transport: Transport
    paths: tuple[str, ...]
    limit: int = 100
    pages: int = 50
    retries: int = 3
    backoff: float = 0.25
    delay: float = 0.0
    total_key: str = "total"
    items_key: str = "items"
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __post_init__(self):
        if self.limit < 1 or self.pages < 1 or not 0 <= self.retries <= MOST_RETRIES:
            raise ValueError(f"limit and pages start at 1, retries go from 0 to {MOST_RETRIES}")
        if not self.paths:
            raise ValueError("no paths to read")

    @property
    def stride(self) -> int:
        return max(1, self.limit - 1)


def pause_of(headers: Mapping[str, str], attempt: int, backoff: float, now: Callable[[], float] = time.time) -> float:
    """Seconds that Retry-After asks for, as a number or as a date; without a valid one the backoff of the attempt (from 0)."""
    said = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    if said is not None:
        if re.fullmatch(r"\s*\d+(?:\.\d+)?\s*", said):
            return float(said)
        try:
            return max(0.0, email.utils.parsedate_to_datetime(said).timestamp() - now())
        except (TypeError, ValueError):
            pass
    return backoff * 2**attempt


def fetched(asking: Asking, path: str, offset: int, limit: int) -> tuple[int, list]:
    """(total, items) of one page. Network errors and AGAIN statuses are retried; other statuses, other content types and other bodies are errors at once."""
    status, why = None, ""
    for attempt in range(asking.retries + 1):
        try:
            answer = asking.transport(path, {"limit": limit, "offset": offset})
        except OSError as e:
            status, why, wait = None, str(e), asking.backoff * 2**attempt
        else:
            if 200 <= answer.status < 300:
                kind = next((v for k, v in answer.headers.items() if k.lower() == "content-type"), "")
                if not JSON_TYPE.match(kind):
                    raise CrawlError(f"{path} at {offset}: expected JSON, not {kind or 'an unnamed type'}")
                try:
                    body = json.loads(answer.body)
                    return int(body[asking.total_key]), list(body[asking.items_key])
                except (ValueError, TypeError, KeyError) as e:
                    raise CrawlError(f"{path} at {offset}: a body without {asking.total_key} and {asking.items_key}") from e
            status, why, wait = answer.status, "", pause_of(answer.headers, attempt, asking.backoff)
            if status not in AGAIN:
                break
        if attempt < asking.retries:
            asking.sleep(wait)
    raise CrawlError(f"{path} at {offset} failed after {attempt + 1} attempts with status {status or 'unavailable'} {why}".rstrip())


class Places(InputPartition):
    """Places from `start` to before `end` of a path; at a fresh start there is nothing before them to hold against."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def cut(asking: Asking, path: str, start: int, end: int) -> list[Places]:
    """A path's places in runs of `pages` pages; none at all is one run, so that the total is reported."""
    size = asking.pages * asking.stride
    return [Places(path, k, min(end, k + size)) for k in range(start, end, size)] or [Places(path, start, end)]


def rows_of(asking: Asking, part: Places) -> Iterator[tuple]:
    """Rows of SCHEMA: own marks the first sight of a place, others are overlaps. A page without items gives one row without an item."""
    at = max(0, part.start - 1) if asking.limit > 1 else part.start
    own_from = part.start
    while True:
        total, found = fetched(asking, part.path, at, asking.limit)
        page = [(at + i, x) for i, x in enumerate(found[: asking.limit]) if at + i < part.end]
        if not page:
            yield part.path, at, None, total, False, None
        for place, x in page:
            yield part.path, at, place, total, place >= own_from, json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        own_from = max(own_from, at + asking.limit)
        if at + asking.limit >= part.end:
            return
        at += asking.stride
        if asking.delay:
            asking.sleep(asking.delay)


class Reader(DataSourceReader):
    def __init__(self, asking: Asking):
        self.asking = asking

    def partitions(self):
        return [p for path in self.asking.paths for p in cut(self.asking, path, 0, fetched(self.asking, path, 0, 1)[0])]

    def read(self, partition):
        yield from rows_of(self.asking, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are how many places of each path have been read. A batch reads from one place before that, so a list that has moved shows; one that has become shorter gives a row without an item."""

    def __init__(self, asking: Asking):
        self.asking = asking

    def initialOffset(self):
        return {path: 0 for path in self.asking.paths}

    def latestOffset(self):
        return {path: fetched(self.asking, path, 0, 1)[0] for path in self.asking.paths}

    def partitions(self, start, end):
        known = [(path, start.get(path, 0), n) for path, n in end.items()]
        return [p for path, a, n in known if a != n for p in cut(self.asking, path, a, n)]

    def read(self, partition):
        yield from rows_of(self.asking, partition)

    def commit(self, end):
        """Nothing is held back for a batch, so nothing is let go."""


def source(transport: Transport, named: str = "crawl") -> type[DataSource]:
    """A data source of this transport, to be registered. Options: paths (a line each), limit, pages, retries, backoff, delay, total_key, items_key."""

    class Crawl(DataSource):
        @classmethod
        def name(cls):
            return named

        def schema(self):
            return SCHEMA

        def asking(self) -> Asking:
            kinds = {"limit": int, "pages": int, "retries": int, "backoff": float, "delay": float, "total_key": str, "items_key": str}
            given = {k.lower(): v for k, v in self.options.items()}
            paths = tuple(dict.fromkeys(p.strip() for p in given.get("paths", "").split("\n") if p.strip()))
            return Asking(transport, paths, **{k: kind(given[k]) for k, kind in kinds.items() if k in given})

        def reader(self, schema):
            return Reader(self.asking())

        def streamReader(self, schema):
            return StreamReader(self.asking())

    return Crawl


def items(rows: DataFrame) -> DataFrame:
    """path, place, item: each place once, without a shuffle."""
    return rows.where("own AND item IS NOT NULL").select("path", "place", "item")


def verdicts(rows: DataFrame, key: str) -> DataFrame:
    """path, total, places, keys, state, reason of a crawl: `stable`, or `unstable` with the first of these reasons.

    total-changed: pages name different totals; overlap-differs: a place was seen with different items; places-missing: fewer places than
    the total; keys-repeat: fewer distinct keys (a JSON path into the item) than places, which a list that moved back gives. Places are summed up
    before paths, so a path of very many places is no task's alone.
    """
    each = rows.groupBy("path", "place").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.min("item").alias("item"), (F.min("item") != F.max("item")).alias("moved"))
    keyed = each.withColumn("key", F.coalesce(F.get_json_object("item", key), F.when(F.col("item").isNotNull(), F.lit(""))))
    by_key = keyed.groupBy("path", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("item").alias("n"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved"))
    whole = by_key.groupBy("path").agg(F.min("low").alias("low"), F.max("high").alias("total"), F.sum("n").alias("places"), F.count("key").alias("keys"), F.max("moved").alias("moved"))
    reason = F.when(F.col("low") != F.col("total"), "total-changed").when(F.col("moved"), "overlap-differs").when(F.col("places") < F.col("total"), "places-missing").when(F.col("keys") < F.col("places"), "keys-repeat")
    return whole.select("path", "total", "places", "keys", F.when(reason.isNull(), "stable").otherwise("unstable").alias("state"), reason.alias("reason"))
