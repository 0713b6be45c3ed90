from __future__ import annotations

import hashlib
import uuid
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayloom.functions import ids, times, urls, values


def one(spark, column, kind="string", value=None):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("day", "week"), [("2024-12-30", "2025-W01"), ("2021-01-03", "2020-W53"), ("2024-01-01", "2024-W01")])
def test_iso_weeks(spark, day, week):
    assert one(spark, times.period(F.col("x"), "week"), value=day) == week


@pytest.mark.parametrize(("text", "seconds"), [("PT5S", 5), ("PT1M", 60), ("PT1H", 3600), ("PT1H30M", 5400), ("PT1H30M15S", 5415), ("PT10M30S", 630), ("P1DT1S", 86401), ("1H", None), ("", None), (None, None), ("P", 0)])
def test_durations(spark, text, seconds):
    assert one(spark, times.iso_duration(F.col("x")), value=text) == seconds


def test_instants(spark):
    at = lambda text: one(spark, F.unix_millis(times.instant(F.col("x"))), value=text)
    assert at("2024-01-01T00:00:00Z") == 1704067200000
    assert at("2023-12-31T19:00:00-05:00") == 1704067200000
    assert at("nonsense") is None and at("") is None
    assert one(spark, times.unix_ms(F.col("x")), value="2024-01-01T00:00:00.5Z") == 1704067200500
    with pytest.raises(Exception, match="without time zone"):
        one(spark, times.unix_ms(F.col("x")), value="2024-01-01T00:00:00")


def test_text_dates_take_the_day_as_written(spark):
    assert one(spark, F.to_date(F.col("x")), value="2024-01-01T23:30:00-05:00") == date(2024, 1, 1)


def test_export_times(spark):
    text = lambda v: one(spark, F.date_format(times.exported_time(F.col("x")), "yyyy-MM-dd HH:mm:ss"), value=v)
    assert text("2024/05/06 07:08:09 JST") == "2024-05-05 22:08:09"
    assert text("2024/05/06 07:08:09") is None
    parse = lambda v: one(spark, F.date_format(times.first_parsed(F.col("x"), times.WATCHED_AT_FORMATS), "yyyy-MM-dd HH:mm"), value=v)
    assert parse("2025-01-02T03:04:05Z") == parse("2025-01-02 03:04:05") == parse("2025年01月02日 03:04") == "2025-01-02 03:04"
    assert parse("yesterday") is None


@pytest.mark.parametrize(("text", "day"), [("今日", "2025-02-01"), ("Yesterday", "2025-01-31"), ("2024年12月31日", "2024-12-31"), ("1月26日", "2025-01-26"), ("12月31日", "2024-12-31"), ("2025/01/26", "2025-01-26"), ("Jan 26, 2025", "2025-01-26"), ("Dec 1", "2024-12-01"), ("?", None)])
def test_relative_days(spark, text, day):
    got = one(spark, times.relative_day(F.col("x"), F.lit("2025-02-01").cast("date")), value=text)
    assert (got.isoformat() if got else None) == day


def test_ids(spark):
    assert one(spark, ids.sha_key(F.lit("o/r"), F.lit(7), F.lit(None))) == hashlib.sha256(b"o/r:7:").hexdigest()
    stamp = lambda v: one(spark, ids.iso_micros(F.col("x")), "timestamp", v)
    assert stamp(datetime(2024, 1, 1, 0, 0, 1)) == "2024-01-01T00:00:01+00:00"
    assert stamp(datetime(2024, 1, 1, 0, 0, 1, 20)) == "2024-01-01T00:00:01.000020+00:00"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=20))
def test_uuid5(spark, names):
    got = [r["y"] for r in spark.createDataFrame([(n,) for n in names], "x string").select(ids.uuid5(F.col("x")).alias("y")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


@pytest.mark.parametrize(
    ("url", "video", "page", "kind"),
    [
        ("https://www.youtube.com/watch?v=abc&t=1", "abc", "https://www.youtube.com/watch?v=abc&t=1", "video"),
        ("https://m.youtube.com/shorts/xyz/a", "xyz", "https://m.youtube.com/shorts/xyz/a", "short"),
        ("https://youtu.be/q1?si=2", "q1", "https://www.youtube.com/watch?v=q1", "video"),
        ("https://YouTu.be/q1/rest", "q1", "https://www.youtube.com/watch?v=q1", "video"),
        ("https://youtu.be/", None, None, "video"),
        ("https://www.youtube.com/feed", None, "https://www.youtube.com/feed", "video"),
        ("https://www.youtube.com/watch?list=1", None, "https://www.youtube.com/watch?list=1", "video"),
        ("https://example.com/watch?v=abc", None, None, "video"),
        ("no url at all", None, None, "video"),
    ],
)
def test_video_urls(spark, url, video, page, kind):
    x = F.col("x")
    row = spark.createDataFrame([(url,)], "x string").select(urls.video_id(x), urls.video_page(x), urls.content_type(x)).first()
    assert tuple(row) == (video, page, kind)


def test_authority_and_host(spark):
    x = F.col("x")
    row = spark.createDataFrame([("http://User@H.com:80/a?b#c",)], "x string").select(urls.authority(x), urls.host(x)).first()
    assert tuple(row) == ("User@H.com:80", "h.com")
    assert one(spark, urls.quoted(F.col("x")), value="a b/ü~*.-_") == "a%20b%2F%C3%BC~%2A.-_"


def test_values(spark):
    assert one(spark, values.first_element(F.col("x")), "array<string>", []) is None
    assert one(spark, values.first_element(F.col("x")), "array<string>", ["a", "b"]) == "a"
    assert one(spark, values.or_else(F.lit(""), F.lit(None), F.col("x")), value="z") == "z"
    assert one(spark, values.safe_long(F.col("x")), value="n/a") is None and one(spark, values.safe_long(F.col("x")), value="12") == 12
    df = spark.createDataFrame([([("a",), (None,), ("",)],)], "x array<struct<name:string>>")
    assert df.select(values.fields_of(F.col("x"), "name")).first()[0] == ["a", None, ""]
    assert df.select(values.fields_of(F.col("x"), "name", True)).first()[0] == ["a"]
