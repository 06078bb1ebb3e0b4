"""Stores merged by key, and streams of fetches."""

import os
import time
import uuid

import pytest

from linkloom.operators import manifest as M
from linkloom.sources.store import Conflict, ManifestStore, Version
from linkloom.streaming import ingest, tracker

ROW = "url string, size long, fetched_at long, state string"


def _rows(spark, rows):
    return M.lenient(spark.createDataFrame(rows, ROW))


def _read(df):
    return {r.url: (r.size, r.fetched_at, r.state) for r in df.collect()}


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_only_the_buckets_of_its_changes(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path), buckets=8)
    assert store.version() is None and _read(store.read()) == {}
    first = store.merge(_rows(spark, [(f"u{i}", i, 1, "done") for i in range(200)]))
    assert first.number == 1 and sum(first.rows.values()) == 200 and len(first.folders) == 8
    before = _files(tmp_path)
    second = store.merge(_rows(spark, [("u7", 70, 5, "failed"), ("u7", 71, 4, "done"), ("u7", 9, 5, "done")]))
    moved = [b for b in range(8) if first.folders[b] != second.folders[b]]
    assert len(moved) == 1 and all(_files(tmp_path)[f] == t for f, t in before.items())
    got = _read(store.read())
    assert got["u7"] == (70, 5, "failed") and len(got) == 200  # of equal times the greater values
    assert _read(store.read(1))["u7"] == (7, 1, "done")
    assert _read(store.lookup(spark.createDataFrame([("u7",), ("none",)], "url string"))) == {"u7": (70, 5, "failed")}
    assert store.remove(spark.createDataFrame([("u7",), (None,)], "url string")).number == 3 and len(_read(store.read())) == 199
    assert store.merge(_rows(spark, [])).number == 3 and store.merge(_rows(spark, [(None, 1, 1, "done")])).number == 3


def test_a_torn_write_is_never_read_and_goes_with_a_vacuum(spark, tmp_path, monkeypatch):
    store = ManifestStore(spark, str(tmp_path), buckets=4)
    store.merge(_rows(spark, [(f"u{i}", i, 1, "done") for i in range(40)]))

    def stopped(self, v):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(ManifestStore, "_publish", stopped)
        with pytest.raises(OSError, match="gone"):
            store.merge(_rows(spark, [(f"u{i}", -1, 2, "done") for i in range(40)]))
    (tmp_path / "versions" / "_half").write_text('{"number": 2, "buck')
    assert {v[0] for v in _read(store.read()).values()} == set(range(40)) and store.versions() == [1]
    store.merge(_rows(spark, [("u1", 100, 3, "done")]))
    left = _read(store.read())
    assert store.vacuum(keep=1) >= 2 and _read(store.read()) == left and store.versions() == [2]


def test_of_two_writers_the_second_merges_again(spark, tmp_path, monkeypatch):
    store = ManifestStore(spark, str(tmp_path), buckets=2)
    store.merge(_rows(spark, [("a", 1, 1, "done"), ("b", 1, 1, "done")]))
    publish, turns = ManifestStore._publish, []

    def beaten(self, v):
        if not turns:
            turns.append(v)
            other = ManifestStore(self.spark, self.folder)
            other._publish = lambda w: publish(other, w)
            other.merge(_rows(spark, [("a", 2, 2, "done")]))
        return publish(self, v)

    with monkeypatch.context() as m:
        m.setattr(ManifestStore, "_publish", beaten)
        assert store.merge(_rows(spark, [("b", 3, 3, "done")])).number == 3
    assert _read(store.read()) == {"a": (2, 2, "done"), "b": (3, 3, "done")}
    with pytest.raises(Conflict):
        store._publish(Version(3, 2))


def test_resizing_deals_all_rows_anew(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path), rows_per_bucket=10)
    assert store.merge(_rows(spark, [("a", 1, 1, "done")])).buckets == 1
    store.merge(_rows(spark, [(f"u{i}", i, 1, "done") for i in range(94)]))
    v = store.resize()
    assert v.buckets == 10 and sum(v.rows.values()) == 95 and len(_read(store.read())) == 95


def test_streams_merge_each_batch_once(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "store"), buckets=4)
    given = tmp_path / "in"
    for k in range(3):
        _rows(spark, [(f"u{i}", 10 * k + i, k, "done") for i in range(k, k + 3)]).coalesce(1).write.mode("append").parquet(str(given))
        time.sleep(0.05)
    stream = spark.readStream.schema(M.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(given))
    ingest.ingest_into(stream, store, str(tmp_path / "check")).awaitTermination()
    assert _read(store.read()) == {"u0": (0, 0, "done"), "u1": (11, 1, "done"), "u2": (22, 2, "done"), "u3": (23, 2, "done"), "u4": (24, 2, "done")}
    now = store.version()
    again = _rows(spark, [("u0", 99, 9, "done")])
    assert store.merge(again, once=(next(iter(now.merged)), 1)) == now  # merged already
    ingest.ingest_into(stream, store, str(tmp_path / "check")).awaitTermination()
    assert store.version() == now


FETCH = "url string, fetched_at long, sha256 string"
HOUR = 3600


def _batch(spark, folder, rows):
    """A file of its own, later than those before it."""
    at = f"{folder}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, FETCH).coalesce(1).write.parquet(at)
    name = next(f for f in os.listdir(at) if f.startswith("part-"))
    os.makedirs(f"{folder}/all", exist_ok=True)
    os.rename(f"{at}/{name}", f"{folder}/all/{uuid.uuid4().hex}.parquet")
    time.sleep(0.05)


def _events(spark, tmp_path):
    return sorted((r.url, r.fetched_at, r.event, r.before, r.seen) for r in spark.read.schema(tracker.EVENTS).parquet(str(tmp_path / "events")).collect())


def test_a_tracker_tells_changes_drops_late_rows_and_expires_across_restarts(spark, tmp_path):
    t = 1_700_000_000

    def run():
        stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/all")
        tracker.track(stream, str(tmp_path / "events"), str(tmp_path / "check"), ttl=10 * HOUR, late=HOUR).awaitTermination()

    _batch(spark, f"{tmp_path}/in", [("a", t, "1"), ("b", t, "1"), ("a", t + 60, "1"), (None, t, "1"), ("c", None, "1")])
    run()
    assert _events(spark, tmp_path) == [("a", t, "added", None, 1), ("a", t + 60, "unchanged", "1", 2), ("b", t, "added", None, 1)]
    _batch(spark, f"{tmp_path}/in", [("a", t + 120, "2"), ("a", t + 30, "9"), ("b", t + 5 * HOUR, None)])
    _batch(spark, f"{tmp_path}/in", [("b", t + 5 * HOUR, "")])
    _batch(spark, f"{tmp_path}/in", [("a", t + HOUR, "late")])  # over an hour behind what was newest a batch before
    run()
    got = _events(spark, tmp_path)
    assert ("a", t + 120, "changed", "1", 4) in got and ("a", t + 30, "stale", "1", 3) in got and ("b", t + 5 * HOUR, "changed", "1", 2) in got
    assert ("b", t + 5 * HOUR, "stale", "", 3) in got and not [e for e in got if e[0] == "a" and e[1] == t + HOUR]
    _batch(spark, f"{tmp_path}/in", [("d", t + 12 * HOUR, "1")])  # the watermark passes a's ten hours
    _batch(spark, f"{tmp_path}/in", [("d", t + 12 * HOUR + 1, "1")])
    run()
    got = _events(spark, tmp_path)
    assert ("a", t + 120, "expired", "2", 4) in got and not [e for e in got if e[0] == "b" and e[2] == "expired"]
    left = tracker.standing(spark.read.schema(tracker.EVENTS).parquet(str(tmp_path / "events")))
    assert {r.url: (r.fetched_at, r.sha256, r.seen) for r in left.collect()} == {"b": (t + 5 * HOUR, "", 3), "d": (t + 12 * HOUR + 1, "1", 2)}
