"""Master tables as numbered snapshots: a crash at any step leaves the last whole one, and two writers cannot overwrite each other unseen.

A snapshot is a folder of its own below the dataset's. What is current is told by small pointer files, numbered; the last that is whole counts. A writer merges
into what it found current, writes a new folder and then creates the next pointer, which fails if another writer was faster; it then begins anew from
what that one wrote. ``files.create_text`` sees to it that only one can be first, on local files, on stores that refuse and on those
that create on condition; where a store does neither, nothing is written.

The log of pointers is bounded: the last ``KEPT`` stay. A writer so slow that the number it wants was used and pruned meanwhile finds a
higher one when it looks again, and begins anew as well. Readers list names and open the last pointer, or the last but one where a writer died over it.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayloom.sources import files

POINTERS = "_pointers"  # Spark's readers pass over names with an underscore
ATTEMPTS = 3
KEPT = 2  # snapshots that stay, so that readers of the last but one can finish


class ConflictError(RuntimeError):
    """Other writers were faster each time."""


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the pointers that are there, in order; none is opened."""
    names = (p.rsplit("/", 1)[1] for p in files.matches(spark, f"{folder}/{POINTERS}/*"))
    return sorted(int(n) for n in names if n.isdigit())


def _pointer(folder: str, number: int) -> str:
    return f"{folder}/{POINTERS}/{number:012d}"


def _pointed(spark: SparkSession, folder: str, number: int) -> str | None:
    """The snapshot that a pointer names; None if its writer died over it."""
    text = files.read_text(spark, _pointer(folder, number))
    return f"{folder}/{text.strip()}" if text.startswith("snapshot-") and text.endswith("\n") else None


def newest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, folder) of the current snapshot; None if there is none."""
    for number in reversed(_numbers(spark, folder)):
        if path := _pointed(spark, folder, number):
            return number, path
    return None


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the current snapshot; None if there is none."""
    found = newest(spark, folder)
    return found[1] if found else None


def _prune(spark: SparkSession, folder: str) -> None:
    """Delete all but the last ``KEPT`` whole pointers, each after the snapshot that it names; dead ones among the last stay."""
    whole = 0
    for number in reversed(_numbers(spark, folder)):
        path = _pointed(spark, folder, number)
        if whole >= KEPT:
            if path:
                files.delete(spark, path)
            files.delete(spark, _pointer(folder, number))
        whole += path is not None


def update(spark: SparkSession, folder: str, merge: Callable[[str | None], DataFrame], attempts: int = ATTEMPTS, wait: float = 1.0) -> str:
    """Publish ``merge(current snapshot)`` as the next snapshot; merged anew, with growing and jittered waits, after a conflict.

    On a store that cannot create a file only if it is not there this is an error, before anything is written.
    """
    files.way_to_create(spark, folder)
    for attempt in range(1, attempts + 1):
        last = max(_numbers(spark, folder), default=0)
        name = f"snapshot-{uuid.uuid4().hex}"
        merge(current(spark, folder)).write.parquet(f"{folder}/{name}")
        mine = last + 1
        if files.create_text(spark, _pointer(folder, mine), f"{name}\n"):
            if max(_numbers(spark, folder), default=mine) == mine:
                _prune(spark, folder)
                return f"{folder}/{name}"
            files.delete(spark, _pointer(folder, mine))  # others used and pruned this number meanwhile
        files.delete(spark, f"{folder}/{name}")
        time.sleep(wait * 2 ** (attempt - 1) * random.uniform(1, 1.1))
    raise ConflictError(f"{folder} was changed by others {attempts} times")


def sweep(spark: SparkSession, folder: str, older_than: float = 86_400) -> list[str]:
    """Delete snapshots that no pointer names and that nothing has changed for so many seconds: what writers left that died. Returns them."""
    named = {_pointed(spark, folder, n) for n in _numbers(spark, folder)}
    last = {path.rsplit("/", 1)[1] for path in named if path}
    left = [p for p in files.matches(spark, f"{folder}/snapshot-*") if p.rsplit("/", 1)[1] not in last and files.modified(spark, p) < time.time() - older_than]
    for path in left:
        files.delete(spark, path)
    return left
