"""SparkSession factory with the settings every query relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "dayloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC with adaptive execution; extra settings as keyword pairs.

    Keys in ``conf`` use double underscores for dots (``spark__sql__shuffle__partitions``).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once per application), for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_dayloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="dayloom-code-")) / "dayloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))  # from the driver's disk to every executor by Spark's file server
    context._dayloom_shipped = True
