"""A paged service as a Spark data source: ``spark.read`` and ``spark.readStream`` with ``.format("paged_service")``.

The option ``service`` names a factory, ``module:callable``, which gets the options and returns an object that answers requests:

* ``count()`` and ``page(offset, limit)`` for reading all of it by offset;
* ``head()``, the newest cursor or None; ``window(since, until, limit)``, the latest ``limit`` items after ``since`` up to ``until``, newest first; and ``cuts(since, until, size)``,
  cursors in order at which the window can be cut into parts of about ``size`` items, for reading what is new.

Items are dictionaries and come out as JSON text. Reading is planned: a batch read asks once for the number of items and gives each task a range of offsets; a
micro-batch is the window between two cursors, cut into parts that tasks read on their own. A stream's offset is the cursor, so a batch
that did not get to its commit is asked for again with the same bounds. In a task the next page is on its way while one is handed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from importlib import import_module
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from dayloom.session import ship
from dayloom.sources.paged import by_window, retrying

NAME = "paged_service"
SIZE = 1000  # items to a request
PART = 20_000  # items to a task


@dataclass
class Offsets(InputPartition):
    first: int
    end: int


@dataclass
class Window(InputPartition):
    since: str | None
    until: str


def ahead(calls: Iterator[Callable[[], Any]]) -> Iterator[Any]:
    """Results of the calls in order, each begun while the one before is handed over."""
    with ThreadPoolExecutor(1) as pool:
        waiting = None
        for call in calls:
            begun = pool.submit(call)
            if waiting is not None:
                yield waiting.result()
            waiting = begun
        if waiting is not None:
            yield waiting.result()


class _Options:
    """What batch and stream readers share. The service is made where it is needed: on the driver to plan, in each task to read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.size, self.part = int(self.options.get("size", SIZE)), int(self.options.get("part", PART))

    def service(self) -> Any:
        module, _, factory = self.options["service"].partition(":")
        return getattr(import_module(module), factory)(self.options)


class OffsetReader(_Options, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        total = retrying(self.service().count)
        return [Offsets(at, min(at + self.part, total)) for at in range(0, total, self.part)] or [Offsets(0, 0)]

    def read(self, partition: Offsets) -> Iterator[tuple[str]]:
        service = self.service()
        starts = range(partition.first, partition.end, self.size)
        calls = (lambda at=at: retrying(lambda: service.page(at, min(self.size, partition.end - at))) for at in starts)
        for page in ahead(calls):
            yield from ((json.dumps(item),) for item in page)


class ChangesReader(_Options, DataSourceStreamReader):
    """Offsets are {"cursor": text}; None before the first item."""

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("since")}

    def latestOffset(self) -> dict:
        head = retrying(self.service().head)
        return {"cursor": head if head is not None else self.options.get("since")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = start["cursor"], end["cursor"]
        if until is None or since == until:
            return [Window(until or "", until or "")]
        cuts = retrying(lambda: self.service().cuts(since, until, self.part))
        inner = [c for c in cuts if (since is None or c > since) and c < until]
        return [Window(a, b) for a, b in zip([since, *inner], [*inner, until])]

    def read(self, partition: Window) -> Iterator[tuple[str]]:
        if partition.since == partition.until:
            return
        service = self.service()
        keys = {"time_of": self.options.get("time", "time"), "id_of": self.options.get("id", "id")}
        yield from ((json.dumps(item),) for item in by_window(service.window, partition.since, partition.until, self.size, **keys))

    def commit(self, end: dict) -> None:
        """Nothing to do: the service keeps no state of its readers."""


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "json string"

    def reader(self, schema: Any) -> DataSourceReader:
        return OffsetReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return ChangesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and give its executors this package."""
    ship(spark)
    spark.dataSource.register(PagedService)


class TableService:
    """A Parquet table that answers like a service; options ``path``, ``time`` and ``id`` (column names). Cursors are ISO times of microseconds.

    Pages by offset come from the row groups that hold them. The reading stays open, so that a task which asks for pages in turn reads its rows once.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.data = ds.dataset(options["path"].removeprefix("file://"), format="parquet")
        self.time, self.id = options.get("time", "time"), options.get("id", "id")
        self._rows: Iterator[pa.RecordBatch] = iter(())
        self._left: pa.RecordBatch | None = None  # read, not asked for yet; its first row is ``_at``
        self._at: int | None = None

    @staticmethod
    def _text(at: datetime) -> str:
        return at.isoformat(timespec="microseconds")

    def _items(self, rows: pa.Table | pa.RecordBatch) -> list[dict[str, Any]]:
        return [{k: self._text(v) if isinstance(v, datetime) else v for k, v in r.items()} for r in rows.to_pylist()]

    def _between(self, since: str | None, until: str) -> Any:
        at = lambda text: pa.scalar(datetime.fromisoformat(text), self.data.schema.field(self.time).type)
        upto = ds.field(self.time) <= at(until)
        return upto if since is None else upto & (ds.field(self.time) > at(since))

    def count(self) -> int:
        return self.data.count_rows()

    def _from(self, offset: int) -> Iterator[pa.RecordBatch]:
        """The table's rows from an offset on: files and row groups before it are passed over by their numbers of rows, the rest is read as it is asked for."""
        skip = offset
        for fragment in self.data.get_fragments():
            rows = fragment.count_rows()
            if skip >= rows:
                skip -= rows
                continue
            for group in fragment.split_by_row_group():
                held = group.row_groups[0].num_rows
                if skip >= held:
                    skip -= held
                    continue
                for batch in group.to_batches(batch_size=SIZE * 8, batch_readahead=1, fragment_readahead=0, use_threads=False):
                    if skip < batch.num_rows:
                        yield batch.slice(skip)
                    skip = max(0, skip - batch.num_rows)

    def page(self, offset: int, limit: int) -> list[dict[str, Any]]:
        if self._at != offset:
            self._rows, self._left, self._at = self._from(offset), None, offset
        items: list[dict[str, Any]] = []
        while len(items) < limit:
            if not self._left:
                self._left = next(self._rows, None)
                if self._left is None:
                    break
            taken = self._left.slice(0, limit - len(items))
            self._left = self._left.slice(len(taken))
            items += self._items(taken)
        self._at = offset + len(items)
        return items

    def head(self) -> str | None:
        newest = pc.max(self.data.to_table(columns=[self.time]).column(0)).as_py()
        return self._text(newest) if newest else None

    def window(self, since: str | None, until: str, limit: int) -> list[dict[str, Any]]:
        rows = self.data.to_table(filter=self._between(since, until))
        chosen = pc.select_k_unstable(rows, limit, [(self.time, "descending"), (self.id, "ascending")])
        return self._items(rows.take(chosen))

    def cuts(self, since: str | None, until: str, size: int) -> list[str]:
        times = self.data.to_table(columns=[self.time], filter=self._between(since, until)).column(0).combine_chunks()
        ordered = times.take(pc.sort_indices(times))
        return sorted({self._text(ordered[i].as_py()) for i in range(size - 1, len(ordered), size)})
