"""Snapshots of masters under concurrency, on stores with and without means to refuse."""

from __future__ import annotations

import threading

import pytest
from py4j.protocol import Py4JJavaError

from dayloom.sources import files, sinks, snapshots
from dayloom.sources.catalog import Lake


def channels(spark, ids):
    return spark.createDataFrame([(i, f"N{i}") for i in ids], "channel_id string, channel_name string")


def ids(lake):
    return sorted(r["channel_id"] for r in lake.scan("youtube/channels").collect())


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))


def test_writers_side_by_side_lose_no_row(spark, lake):
    folder = lake.folder("youtube/channels")
    start = threading.Barrier(4)
    failed = []

    def write(me):
        start.wait()
        for n in range(2):
            try:
                merge = lambda now, n=n: (lake.spark.read.parquet(now).union(channels(spark, [f"{me}{n}"])) if now else channels(spark, [f"{me}{n}"])).coalesce(1)
                snapshots.update(spark, folder, merge, attempts=40, wait=0)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in "abcd"]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and ids(lake) == sorted(f"{w}{n}" for w in "abcd" for n in range(2))
    assert len(files.matches(spark, f"{folder}/_pointers/*")) == snapshots.KEPT == len(files.matches(spark, f"{folder}/snapshot-*"))


def test_a_store_without_atomic_create_is_refused_before_anything_is_written(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.plain.link./in", f"file://{tmp_path}")
    lake = Lake(spark, "viewfs://plain/in")
    with pytest.raises(files.UnsafeStoreError, match="viewfs"):
        sinks.upsert_master(channels(spark, "a"), lake, "youtube/channels")
    assert not list(tmp_path.iterdir())
    spark.conf.set("dayloom.stores.refusing", "other,viewfs")  # whoever runs it vouches for it
    try:
        sinks.upsert_master(channels(spark, "a"), lake, "youtube/channels")
        sinks.upsert_master(channels(spark, "b"), lake, "youtube/channels")
        assert ids(lake) == ["a", "b"]
    finally:
        spark.conf.unset("dayloom.stores.refusing")


class Store:
    """An object store's client: its plain create looks and then writes; on condition it decides when a file is closed."""

    def __init__(self, conditional):
        self.conditional, self.objects, self.asked = conditional, {}, []

    def getUri(self):
        return self

    def getScheme(self):
        return "s3a"

    def hasPathCapability(self, path, name):
        return self.conditional and name == files.CONDITIONAL

    def createFile(self, path):
        self.path = path
        return self

    def must(self, option, value):
        self.asked.append((option, value))
        return self

    def create(self, *plain):
        assert not plain, "a plain create on an object store"
        return self

    def build(self):
        return Upload(self, self.path)


class Upload:
    def __init__(self, store, path):
        self.store, self.path, self.text = store, path, ""

    def writeBytes(self, text):
        self.text += text

    def close(self):
        if self.path in self.store.objects:
            raise Refused()
        self.store.objects[self.path] = self.text


class Refused(Py4JJavaError):
    def __init__(self):
        Exception.__init__(self, "412")
        self.java_exception = self

    def getClass(self):
        return self

    def getName(self):
        return "org.apache.hadoop.fs.s3a.RemoteFileChangedException"

    def getMessage(self):
        return "PUT 0-length: status code 412"

    def __str__(self):
        return "412"


def test_an_object_store_creates_on_condition(spark, monkeypatch):
    store = Store(True)
    monkeypatch.setattr(files, "_at", lambda s, p: (store, p))
    assert files.create_text(spark, "s3a://b/1", "first\n") and not files.create_text(spark, "s3a://b/1", "second\n")
    assert store.objects == {"s3a://b/1": "first\n"} and store.asked == [(files.CONDITIONAL, "true")] * 2
    store.conditional = False
    with pytest.raises(files.UnsafeStoreError):
        files.create_text(spark, "s3a://b/2", "x")


def test_a_writer_that_slept_over_pruned_numbers_begins_anew(spark, lake, monkeypatch):
    sinks.upsert_master(channels(spark, "a"), lake, "youtube/channels")
    real, slept = files.create_text, []

    def create(s, path, text):
        if not slept:
            slept.append(path)
            for i in "bcdef":
                sinks.upsert_master(channels(spark, i), lake, "youtube/channels")
            assert not files.exists(s, path)  # its number was used and pruned
        return real(s, path, text)

    monkeypatch.setattr(snapshots.files, "create_text", create)
    sinks.upsert_master(channels(spark, "z"), lake, "youtube/channels")
    assert ids(lake) == list("abcdefz")


def test_readers_open_two_pointers_at_most(spark, lake, monkeypatch):
    for i in "abcd":
        sinks.upsert_master(channels(spark, i), lake, "youtube/channels")
    folder = lake.folder("youtube/channels")
    files.create_text(spark, f"{folder}/_pointers/{5:012d}", "")  # a writer died over it
    opened = []
    real = files.read_text
    monkeypatch.setattr(snapshots.files, "read_text", lambda s, p: opened.append(p) or real(s, p))
    assert ids(lake) == list("abcd") and len(opened) == 2


def test_a_sweep_takes_only_old_orphans(spark, lake):
    for i in "abc":
        sinks.upsert_master(channels(spark, i), lake, "youtube/channels")
    folder = lake.folder("youtube/channels")
    channels(spark, "x").write.parquet(f"{folder}/snapshot-left")
    assert snapshots.sweep(spark, folder) == []
    assert [p.rsplit("/", 1)[1] for p in snapshots.sweep(spark, folder, older_than=-5)] == ["snapshot-left"]
    assert ids(lake) == list("abc")


def test_the_newer_of_two_masters_counts_wherever_it_is(spark, tmp_path):
    far, near = Lake(spark, str(tmp_path / "far")), Lake(spark, str(tmp_path / "near"))
    sinks.upsert_master(channels(spark, "a"), far, "youtube/channels")
    sinks.upsert_master(channels(spark, "a"), near, "youtube/channels")
    both = Lake(spark, far.root, near.root)
    assert near.root in both._parts("youtube/channels", "compacted")[0][0]
    sinks.upsert_master(channels(spark, "b"), far, "youtube/channels")
    assert ids(both) == ["a", "b"]
