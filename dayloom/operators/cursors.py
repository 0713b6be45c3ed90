"""Incremental windows and target months."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, date, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.sources import files
from dayloom.sources.catalog import Lake


def since(df: DataFrame, time: str, last: str | None, until: str | None = None) -> DataFrame:
    """Rows after ``last``, up to and including ``until``; no bound where it is None."""
    if last is not None:
        df = df.where(F.col(time) > F.lit(last).cast(df.schema[time].dataType))
    if until is not None:
        df = df.where(F.col(time) <= F.lit(until).cast(df.schema[time].dataType))
    return df


def window_page(df: DataFrame, time: str, last: str | None, until: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows of the window, the latest first: one page of an initial load."""
    return since(df, time, last, until).orderBy(F.desc(time)).limit(cap)


def latest(df: DataFrame, time: str) -> DataFrame:
    """One row with the greatest time, the next cursor."""
    return df.agg(F.max(time).alias("cursor"))


def target_months(year: int | None = None, month: int | None = None, today: date | None = None) -> list[tuple[int, int]]:
    """The month asked for, or today's and, for rows that come late, the one before it."""
    asked = year is not None and month is not None
    now = today or datetime.now(UTC).date()
    last = 12 * year + month - 1 if asked else 12 * now.year + now.month - 1  # months since the year 0
    return [(m // 12, m % 12 + 1) for m in range(last - (not asked), last + 1)]


def run_all(steps: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Run every step even if some fail; then raise one error that lists those."""
    done: dict[str, object] = {}
    failed: dict[str, Exception] = {}
    for name, step in steps.items():
        try:
            done[name] = step()
        except Exception as e:  # noqa: BLE001  collected and raised below
            failed[name] = e
    if failed:
        raise RuntimeError("; ".join(f"{n}: {e}" for n, e in failed.items()))
    return done


class Cursor:
    """A cursor in a small JSON file in the lake; ``advance`` replaces it in one step, and only after the work it stands for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def of(cls, lake: Lake, source: str, *parts: str) -> Cursor:
        """The cursor of a source, or of one device, browser and profile of it."""
        return cls(lake.spark, "/".join([lake.root, "state", source, *(quote(p, safe="") for p in parts), "cursor.json"]))

    def read(self) -> str | None:
        return json.loads(files.read_text(self.spark, self.path))["cursor"] if files.exists(self.spark, self.path) else None

    def advance(self, cursor: str) -> None:
        files.replace_text(self.spark, self.path, json.dumps({"cursor": cursor}))
