"""Services that answer in pages or for batches of ids, as rows of JSON text for ``from_json``.

``fetch`` functions do the request and are given by the caller; they may raise ``ServiceError`` with a status. Reading by
pages is a chain of requests by nature, so it is one task for each resource; lookups by id run in parallel.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.session import ship

ATTEMPTS = 3
BATCH = 50
UPLOAD = 1000


class ServiceError(Exception):
    """A failed request; ``quota`` tells that the service refuses more for now."""

    def __init__(self, status: int, message: str = "", quota: bool = False) -> None:
        super().__init__(message or f"status {status}")
        self.status, self.quota = status, quota


def retrying(call: Callable[[], Any], attempts: int = ATTEMPTS, wait: float = 1.0) -> Any:
    """The call's result; tried again, with growing and jittered waits, unless the request itself is at fault (status 400 to 499)."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except (ServiceError, OSError) as e:
            if n == attempts or isinstance(e, ServiceError) and 400 <= e.status < 500:
                raise
            time.sleep(wait * 2 ** (n - 1) * random.uniform(1, 1.1))
    return None


def by_offset(fetch: Callable[[int, int], dict[str, Any] | None], size: int, most: int | None = None) -> Iterator[dict[str, Any]]:
    """Items of answers {items, next} to (offset, limit), until one is empty or names no next, or ``most`` are read."""
    read = 0
    while most is None or read < most:
        answer = retrying(lambda: fetch(read, size)) or {}
        page = answer.get("items") or []
        yield from page if most is None else page[: most - read]
        read += len(page)
        if not page or not answer.get("next"):
            return


def _instant(text: str | None) -> datetime | None:
    """ISO-8601 text as an instant; without a zone it is taken as UTC."""
    at = datetime.fromisoformat(text) if text else None
    return at if at is None or at.tzinfo else at.replace(tzinfo=UTC)


def by_window(fetch: Callable[[str | None, str, int], list[dict[str, Any]]], since: str | None, until: str, size: int, time_of: str = "visit_time", id_of: str = "visit_id") -> Iterator[dict[str, Any]]:
    """Items after ``since`` up to ``until``, the latest first, of a source that gives at most ``size`` of them to (since, until, size).

    The end of the window moves to the oldest item of each page, which is asked for again, since others may share its time; items
    that came before are left out by their id. Where a whole page has one time, more are asked for.
    """
    end, asked, edge = until, size, set()
    while page := retrying(lambda: fetch(since, end, asked)):
        yield from (x for x in page if x[id_of] not in edge)
        if len(page) < asked:
            return
        oldest = page[-1][time_of]
        if _instant(oldest) == _instant(end) and len({_instant(x[time_of]) for x in page}) == 1:
            edge |= {x[id_of] for x in page}
            asked *= 2
            continue
        edge = {x[id_of] for x in page if _instant(x[time_of]) == _instant(oldest)}
        end, asked = oldest, size


def in_batches(items: Iterable[dict[str, Any]], send: Callable[[list[dict[str, Any]]], object], size: int = UPLOAD, attempts: int = ATTEMPTS, wait: float = 5.0) -> int:
    """Send items ``size`` at a time, each batch tried again if it fails; the number sent. A batch that fails for good ends it with its error."""
    sent, rest = 0, iter(items)
    while batch := list(islice(rest, size)):
        retrying(lambda batch=batch: send(batch), attempts, wait)
        sent += len(batch)
    return sent


def by_page(fetch: Callable[[int], list[dict[str, Any]]], size: int, since: str | None = None, time_of: str = "updated_at") -> Iterator[dict[str, Any]]:
    """Items of pages 1, 2, ... that come newest first; with ``since``, older ones are left out and end the reading.

    Items without a time are kept. ISO-8601 times are compared as instants.
    """
    number, first = 1, _instant(since)
    old = lambda x: first is not None and bool(x.get(time_of)) and _instant(x[time_of]) < first
    while page := retrying(lambda: fetch(number)):
        yield from (x for x in page if not old(x))
        if len(page) < size or old(page[-1]):
            return
        number += 1


def read_resources(resources: DataFrame, read: Callable[[dict[str, Any]], Iterator[dict[str, Any]]]) -> DataFrame:
    """Rows (resource columns, json) of everything ``read`` yields for each row of ``resources``, a task for each few of them."""
    ship(resources.sparkSession)
    names = resources.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found = [json.dumps(x) for x in read(row)]
                if found:
                    yield pd.DataFrame({**{n: [row[n]] * len(found) for n in names}, "json": found})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in resources.schema)
    return resources.mapInPandas(run, f"{schema}, json string")


def lookup(ids: DataFrame, column: str, fetch: Callable[[list[str]], list[dict[str, Any] | None]], size: int = BATCH, quota_ends: bool = False) -> DataFrame:
    """Rows (json) of the items that ``fetch`` gives for distinct ids, ``size`` to a request; missing items are left out.

    A refusal for quota fails the job; with ``quota_ends`` it ends the asking of that task instead, and what was answered until then is the result.
    """
    ship(ids.sparkSession)

    def answers(part: list[str]) -> Iterator[pd.DataFrame]:
        if found := [json.dumps(x) for x in retrying(lambda: fetch(part)) if x]:
            yield pd.DataFrame({"json": found})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from asked(batches)
        except ServiceError as e:
            if not (e.quota and quota_ends):
                raise

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for batch in batches:
            waiting += batch[column].tolist()
            while len(waiting) >= size:
                part, waiting = waiting[:size], waiting[size:]
                yield from answers(part)
        if waiting:
            yield from answers(waiting)

    return ids.select(F.col(column).cast("string").alias(column)).where(F.col(column) != "").distinct().mapInPandas(run, "json string")
