"""Listing and moving files on any Hadoop file system, from the driver."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


CONDITIONAL = "fs.option.create.conditional.overwrite"  # fixed value: Hadoop's name of the option and of the capability
REFUSING = frozenset(("hdfs", "abfs", "abfss", "gs"))  # fixed values: schemes whose create without overwriting is one step


class UnsafeStoreError(RuntimeError):
    """The store cannot tell two writers of one file apart."""


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted; none if there are none."""
    fs, path = _at(spark, pattern)
    found = fs.globStatus(path)
    return sorted(f.getPath().toString() for f in found) if found else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scheme(spark: SparkSession, path: str) -> str:
    fs, _ = _at(spark, path)
    return fs.getUri().getScheme() or "file"


def way_to_create(spark: SparkSession, path: str) -> str:
    """How a file can be created here only if there is none of its name: ``link`` (local), ``refuse`` (the store's plain create does) or ``condition``.

    Stores whose plain create looks first and writes later, as S3 clients do, must offer the conditional option. One that offers
    nothing is an error: two writers could both believe to be first. ``dayloom.stores.refusing`` names further schemes that refuse.
    """
    fs, p = _at(spark, path)
    kind = fs.getUri().getScheme() or "file"
    if kind == "file":
        return "link"
    if fs.hasPathCapability(p, CONDITIONAL):
        return "condition"
    if kind in REFUSING or kind in (spark.conf.get("dayloom.stores.refusing", None) or "").split(","):
        return "refuse"
    raise UnsafeStoreError(f"{kind}: neither refuses to create a file that is there nor offers {CONDITIONAL}")


def _link(path: str, text: str) -> bool:
    """Write under another name and give the file its own by a hard link, which the system refuses if the name is taken."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}.part")
    part.write_text(text, encoding="ascii")
    try:
        os.link(part, target)
    except FileExistsError:
        return False
    finally:
        part.unlink()
    return True


def _taken(error: Py4JJavaError) -> bool:
    """Whether a store says that the file is there: by its own exception or by the answer of a failed condition."""
    raised = error.java_exception
    return any(x in raised.getClass().getName() for x in ("AlreadyExists", "RemoteFileChanged", "PreconditionFailed")) or "412" in str(raised.getMessage())


def _create(fs, p, text: str, conditional: bool) -> bool:  # noqa: ANN001
    """Create by the store's own means; a condition is checked when the file is closed."""
    try:
        stream = fs.createFile(p).must(CONDITIONAL, "true").create().build() if conditional else fs.create(p, False)
        stream.writeBytes(text)
        stream.close()
    except Py4JJavaError as e:
        if _taken(e):
            return False
        raise
    return True


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small ASCII file; False if there is one of that name. Of several writers one gets True, on any store that this accepts."""
    way = way_to_create(spark, path)
    fs, p = _at(spark, path)
    return _link(p.toUri().getPath(), text) if way == "link" else _create(fs, p, text, way == "condition")


def modified(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds since 1970."""
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small ASCII file in the place of another in one step: written under another name, then renamed over it."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    _create(*_at(spark, part), text, False)
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    old, new = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs, _ = _at(spark, path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(new), over)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def mirror(source: Path, target: Path) -> dict[str, int | list[str]]:
    """Copy files under ``source`` that are missing in ``target`` or differ in size; each by a temporary name and a rename.

    A file that fails is listed and the rest go on. Pointers to snapshots come after what they point to.
    """
    copied = skipped = 0
    failed: list[str] = []
    for f in sorted((p for p in Path(source).rglob("*") if p.is_file()), key=lambda p: ("_pointers" in p.parts, p)):
        name = f.relative_to(source)
        to = Path(target) / name
        try:
            if to.exists() and to.stat().st_size == f.stat().st_size:
                skipped += 1
                continue
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_name(f".{to.name}.part")
            shutil.copyfile(f, part)
            part.replace(to)
            copied += 1
        except OSError:
            failed.append(str(name))
    return {"copied": copied, "skipped": skipped, "failed": failed}


def object_store_settings(bucket: str, endpoint: str, key: str, secret: str, region: str = "auto") -> dict[str, str]:
    """Spark settings for one bucket of an S3-compatible store with path-style access."""
    p = f"spark.hadoop.fs.s3a.bucket.{bucket}."
    return {
        f"{p}endpoint": endpoint,
        f"{p}access.key": key,
        f"{p}secret.key": secret,
        f"{p}endpoint.region": region,
        f"{p}path.style.access": "true",
    }
