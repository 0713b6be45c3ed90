from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dayloom.sources import paged


def offsets(total):
    def fetch(offset, limit):
        items = [{"n": i} for i in range(offset, min(total, offset + limit))]
        return {"items": items, "next": "more" if offset + limit < total else None}

    return fetch


def test_offsets():
    assert [x["n"] for x in paged.by_offset(offsets(7), 3)] == list(range(7))
    assert [x["n"] for x in paged.by_offset(offsets(7), 3, most=4)] == [0, 1, 2, 3]
    assert list(paged.by_offset(lambda o, n: None, 3)) == [] and list(paged.by_offset(offsets(5), 3, most=0)) == []


def test_pages_end_when_they_are_old_or_short():
    pages = [[{"updated_at": "2024-01-09"}, {"updated_at": "2024-01-08"}], [{"updated_at": "2024-01-07"}, {"updated_at": "2024-01-05"}], [{"updated_at": "2024-01-04"}, {"updated_at": None}], [{"updated_at": "2024-01-01"}]]
    asked = []

    def fetch(n):
        asked.append(n)
        return pages[n - 1] if n <= len(pages) else []

    assert len(list(paged.by_page(fetch, 2))) == 7 and asked == [1, 2, 3, 4]
    asked.clear()
    assert [x["updated_at"] for x in paged.by_page(fetch, 2, since="2024-01-06")] == ["2024-01-09", "2024-01-08", "2024-01-07"] and asked == [1, 2]


def test_pages_compare_instants():
    pages = [[{"updated_at": "2024-01-01T00:00:00.500Z"}, {"updated_at": "2024-01-01T00:00:00Z"}, {"updated_at": "2024-01-01T00:30:00+01:00"}]]
    found = paged.by_page(lambda n: pages[n - 1] if n <= 1 else [], 3, since="2024-01-01T00:00:00Z")
    assert len(list(found)) == 2


def test_windows_move_their_end_and_lose_no_ties(monkeypatch):
    times = ["00:09", "00:07", "00:07", "00:07", "00:07", "00:07", "00:05", "00:03", "00:03", "00:01"]
    visits = [{"visit_id": i, "visit_time": f"2024-01-01T00:{t}Z"} for i, t in enumerate(times)]

    def fetch(since, until, size):
        return [v for v in visits if (since is None or v["visit_time"] > since) and v["visit_time"] <= until][:size]

    for size in (1, 2, 3, 4, 100):
        got = [v["visit_id"] for v in paged.by_window(fetch, "2024-01-01T00:00:01Z", "2024-01-01T01:00:00Z", size)]
        assert got == list(range(9))
    assert list(paged.by_window(fetch, None, "2023-01-01T00:00:00Z", 3)) == []


def test_batches_are_tried_again_and_the_cursor_moves_last(spark, tmp_path):
    from dayloom.operators import cursors, jobs

    visits = [{"visit_id": i, "visit_time": f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z"} for i in reversed(range(2500))]
    fetch = lambda since, until, size: [v for v in visits if (since is None or v["visit_time"] > since) and v["visit_time"] <= until][:size]
    sent, fails = [], [True, False, True, True, False, False]

    def send(batch):
        if fails and fails.pop(0):
            raise paged.ServiceError(503)
        sent.append(len(batch))

    c = cursors.Cursor(spark, str(tmp_path / "cursor.json"))
    assert jobs.push_visits(fetch, send, c, "2024-01-01T00:59:59Z", page=700, wait=0) == 2500
    assert sent == [1000, 1000, 500] and c.read() == "2024-01-01T00:59:59Z"
    with pytest.raises(paged.ServiceError):
        jobs.push_visits(lambda *a: visits[:1], lambda b: (_ for _ in ()).throw(paged.ServiceError(503)), c, "2025-01-01T00:00:00Z", wait=0)
    assert c.read() == "2024-01-01T00:59:59Z"


def test_retries():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise paged.ServiceError(503)
        return "ok"

    assert paged.retrying(flaky, wait=0) == "ok"
    for error in (paged.ServiceError(404), paged.ServiceError(403, quota=True)):
        tries.clear()
        with pytest.raises(paged.ServiceError):
            paged.retrying(lambda error=error: (tries.append(1), (_ for _ in ()).throw(error)), wait=0)
        assert len(tries) == 1


def test_lookups_go_in_batches(spark):
    def fetch(ids):
        assert len(ids) <= 50 and len(set(ids)) == len(ids)
        return [None if i == "7" else {"id": i} for i in ids]

    ids = spark.range(230).select((F.col("id") % 115).cast("string").alias("id")).union(spark.createDataFrame([("",), (None,)], "id string"))
    got = sorted(json.loads(r["json"])["id"] for r in paged.lookup(ids, "id", fetch).collect())
    assert got == sorted(str(i) for i in range(115) if i != 7)


def test_resources(spark):
    repos = spark.createDataFrame([("a", 3), ("b", 0)], "repo string, n int")
    rows = paged.read_resources(repos, lambda r: iter([{"k": i} for i in range(r["n"])]))
    assert [(r["repo"], json.loads(r["json"])["k"]) for r in rows.orderBy("json").collect()] == [("a", 0), ("a", 1), ("a", 2)]
