"""Dates, instants, periods and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month")


def period(ts: Column, granularity: str) -> Column:
    """Label of the day (2024-01-05), ISO week (2024-W01) or month (2024-01) that a timestamp, date or ISO text falls in."""
    day = F.to_date(ts)
    if granularity == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if granularity == "week":
        week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), week)
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError(f"invalid_granularity: must be one of: {', '.join(sorted(GRANULARITIES))}")


def in_order(periods: DataFrame) -> DataFrame:
    """One row for each period, sorted, null last. There are no more rows than days, so one partition holds them and nothing is sampled for a sort by range."""
    return periods.coalesce(1).sortWithinPartitions(F.asc_nulls_last("period"))


def within_days(ts: Column, start: str, end: str) -> Column:
    """Whether the date of ``ts`` lies in [start, end]; on a timestamp column the filter reaches the Parquet scan."""
    return F.to_date(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def instant(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; null where it is none. Needs the session time zone UTC."""
    return F.try_to_timestamp(text)


def as_utc(ts: Column) -> Column:
    """A naive or zoned timestamp as an instant; naive ones are taken as UTC (the session's zone)."""
    return ts.cast("timestamp")


def unix_ms(text: Column) -> Column:
    """ISO-8601 text with a zone to milliseconds since 1970; an error for text without a zone, null for null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    fail = F.raise_error(F.concat(F.lit("timestamp without time zone: "), text)).cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).when(zoned, F.unix_millis(F.to_timestamp(text))).otherwise(fail)


def first_parsed(text: Column, formats: list[str]) -> Column:
    """The timestamp by the first format that fits, as UTC; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: Formats of watch times in exported activity.
WATCHED_AT_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy年MM月dd日 HH:mm"]


def exported_time(text: Column) -> Column:
    """``2024/05/06 07:08:09 JST`` to UTC; null for other text."""
    clock = F.regexp_extract(text, r"^\s*(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+JST", 1)
    local = F.try_to_timestamp(F.regexp_replace(clock, r"\s+", " "), F.lit("yyyy/MM/dd HH:mm:ss"))
    return F.when(clock != "", local - F.expr("INTERVAL 9 HOURS"))


def relative_day(text: Column, today: Column) -> Column:
    """A day heading: today, yesterday, a full date, or a month and day that is put in the last year it is not in the future."""
    clean = F.trim(text)
    try_date = lambda fmt, x=clean: F.try_to_timestamp(x, F.lit(fmt)).cast("date")
    full = F.coalesce(try_date("yyyy年M月d日"), try_date("yyyy/M/d"), try_date("MMM d, yyyy"))
    year = F.year(today).cast("string")
    bare = F.coalesce(try_date("yyyy M月d日", F.concat(year, F.lit(" "), clean)), try_date("yyyy MMM d", F.concat(year, F.lit(" "), clean)))
    bare = F.when(bare > today, F.add_months(bare, -12)).otherwise(bare)
    return (
        F.when(clean.contains("今日") | clean.contains("Today"), today)
        .when(clean.contains("昨日") | clean.contains("Yesterday"), F.date_sub(today, 1))
        .otherwise(F.coalesce(full, bare))
    )


def iso_duration(text: Column) -> Column:
    """Seconds of an ISO-8601 duration such as P1DT2H3M4S; null unless it begins with P."""
    clock = F.coalesce(F.get(F.split(text, "T", 2), F.lit(1)), F.lit(""))
    part = lambda source, unit: F.coalesce(F.nullif(F.regexp_extract(source, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    seconds = part(text, "D") * 86_400 + part(clock, "H") * 3_600 + part(clock, "M") * 60 + part(clock, "S")
    return F.when(text.startswith("P"), seconds)


def month_columns(ts: Column) -> dict[str, Column]:
    """The year and month that a row is filed under; null for unparsable text."""
    day = ts.cast("string").substr(1, 10)
    known = F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return {"year": F.year(known), "month": F.month(known)}
