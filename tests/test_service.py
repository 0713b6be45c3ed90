"""A paged service as a data source: planned partitions, cursors as offsets, replay after a crash."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from dayloom.sources import service
from dayloom.sources.paged import ServiceError
from dayloom.streaming import streams


class Fake:
    """Items in a JSON file, times as text; every request leaves a note, and the first of each kind fails."""

    def __init__(self, options):
        self.folder = Path(options["folder"])
        self.items = sorted(json.loads((self.folder / "items.json").read_text()), key=lambda x: (x["time"], x["id"]))

    def note(self, text):
        with (self.folder / "requests").open("a") as f:
            f.write(text + "\n")
        failed = self.folder / f"failed-{text.split()[0]}"
        if not failed.exists():
            failed.touch()
            raise ServiceError(503)

    def count(self):
        self.note("count")
        return len(self.items)

    def page(self, offset, limit):
        self.note(f"page {offset} {limit}")
        return self.items[offset : offset + limit]

    def head(self):
        return self.items[-1]["time"] if self.items else None

    def window(self, since, until, limit):
        self.note(f"window {since} {until}")
        return [x for x in self.items[::-1] if (since is None or x["time"] > since) and x["time"] <= until][:limit]

    def cuts(self, since, until, size):
        inside = [x["time"] for x in self.items if (since is None or x["time"] > since) and x["time"] <= until]
        return sorted(set(inside[size - 1 :: size]))


def items(first, end):
    return [{"id": i, "time": f"2024-01-01T00:{i // 7 // 60:02d}:{i // 7 % 60:02d}"} for i in range(first, end)]  # seven share a time


@pytest.fixture
def folder(spark, tmp_path):
    service.register(spark)
    (tmp_path / "items.json").write_text(json.dumps(items(0, 252)))
    return tmp_path


def options(folder, **more):
    return {"service": "tests.test_service:Fake", "folder": str(folder), "size": "20", "part": "60", **more}


def test_offsets_are_planned_once_and_read_by_tasks(spark, folder):
    df = spark.read.format(service.NAME).options(**options(folder)).load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(json.loads(r["json"])["id"] for r in df.collect()) == list(range(252))
    asked = (folder / "requests").read_text().split("\n")
    assert "page 240 12" in asked and max(int(a.split()[2]) for a in asked if a.startswith("page")) == 20
    (folder / "items.json").write_text("[]")
    assert spark.read.format(service.NAME).options(**options(folder)).load().count() == 0


def read_new(spark, folder, work):
    stream = spark.readStream.format(service.NAME).options(**options(folder)).load()
    return streams.run_available(stream, str(folder / "checkpoint"), work)


def test_a_stream_reads_what_is_new_once_even_if_a_batch_dies_before_its_commit(spark, folder):
    out = str(folder / "out")
    append = lambda batch, n: batch.write.mode("append").parquet(out)
    landed = lambda: sorted(json.loads(r["json"])["id"] for r in spark.read.parquet(out).collect())
    once = streams.once_per_batch(append, str(folder / "ledger"))
    read_new(spark, folder, once)
    assert landed() == list(range(252))
    windows = {line for line in (folder / "requests").read_text().split("\n") if line.startswith("window None")}
    assert len(windows) >= 2  # the first part of several, in pages
    (folder / "items.json").write_text(json.dumps(items(0, 399)))

    def dies(batch, n):
        once(batch, n)  # landed and noted in the ledger ...
        raise RuntimeError("lost before the commit")

    with pytest.raises(Exception, match="lost before the commit"):
        read_new(spark, folder, dies)
    (folder / "items.json").write_text(json.dumps(items(0, 602)))
    read_new(spark, folder, once)  # ... so its replay is passed over, and what came meanwhile is the next batch
    read_new(spark, folder, once)
    assert landed() == list(range(602))


def test_a_batch_that_dies_before_it_lands_is_read_again_with_the_same_bounds(spark, folder):
    seen = []

    def dies(batch, n):
        seen.append((n, batch.count()))
        raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        read_new(spark, folder, dies)
    (folder / "items.json").write_text(json.dumps(items(0, 301)))
    read_new(spark, folder, lambda batch, n: seen.append((n, batch.count())))
    read_new(spark, folder, lambda batch, n: seen.append((n, batch.count())))
    assert seen[:2] == [(0, 252), (0, 252)] and sum(n for _, n in seen[1:]) == 301


def test_an_empty_service_streams_nothing(spark, folder):
    (folder / "items.json").write_text("[]")
    seen = []
    read_new(spark, folder, lambda batch, n: seen.append(batch.count()))
    assert sum(seen) == 0


def test_pages_of_a_table_come_from_their_row_groups_by_one_reading(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for part in (0, 1):
        pq.write_table(pa.table({"id": list(range(part * 50, part * 50 + 50))}), tmp_path / f"{part}.parquet", row_group_size=7)
    table = service.TableService({"path": str(tmp_path)})

    class Whole:  # what a page may ask of the table; ``take`` reads all of it for each page
        readings = 0

        def __init__(self, data):
            self.data = data

        def get_fragments(self):
            self.readings += 1
            return self.data.get_fragments()

    table.data = Whole(table.data)
    ids = lambda offset, limit: [x["id"] for x in table.page(offset, limit)]
    assert ids(40, 8) + ids(48, 8) + ids(56, 0) + ids(56, 8) == list(range(40, 64)) and table.data.readings == 1
    assert ids(3, 5) == list(range(3, 8)) and ids(98, 9) == [98, 99] and ids(100, 5) == [] and ids(500, 5) == []
