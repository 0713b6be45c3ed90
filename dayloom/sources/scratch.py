"""The folder for intermediate tables: shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from dayloom.sources import files

_made: list[str] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that were handed out within, once the work is written elsewhere; nothing that is read later may lie in them."""
    first = len(_made)
    yield
    for path in _made[first:]:
        files.delete(spark, path)
    del _made[first:]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; under a local one only where that is unset and all runs on this machine; unset on a cluster it is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        found = context._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root and context.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="dayloom-")
        context.setCheckpointDir(root)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _made.append(f"{root.rstrip('/')}/dayloom-{uuid.uuid4().hex}")
    return _made[-1]
