"""A manifest kept on disk by key: merged bucket by bucket, each version published by one pointer.

Rows are in buckets by a hash of their URL.  A merge reads and writes only the buckets that its changes fall into, so what is written follows
the change and not the table; a version is a small file that names each bucket's folder, and is published by renaming it to its number, which
fails if another writer was first.  Data that no version names is never read, so a torn write does no harm; readers keep the version
that they began with until vacuum() drops it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import manifest
from linkloom.session import cut

_DIGITS = 7


class Conflict(RuntimeError):
    """Another writer published a version first."""


@dataclass(frozen=True)
class Version:
    """number; buckets: how many there are; folders: those of the buckets that have rows; rows: by bucket; merged: the last batch of each stream."""

    number: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Version:
        found = json.loads(text)
        by_bucket = {k: {int(b): v for b, v in found[k].items()} for k in ("folders", "rows")}
        return cls(found["number"], found["buckets"], merged=found["merged"], **by_bucket)


def bucket_of(url: Column, buckets: int) -> Column:
    """The bucket of a URL: the first digits of its MD5, modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(url, "UTF-8")), 1, _DIGITS), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class ManifestStore:
    """A manifest in a folder.  A new one has the given number of buckets, or as many as its rows need; resize() deals it anew."""

    def __init__(self, spark: SparkSession, folder: str, rows_per_bucket: int = 250_000, buckets: int | None = None):
        self.spark, self.folder, self.rows_per_bucket, self.buckets = spark, folder.rstrip("/"), rows_per_bucket, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        root = self._path(self.folder)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), spark._jsc.hadoopConfiguration())

    # Versions

    def _names(self, sub: str) -> Iterator[str]:
        at = self._path(f"{self.folder}/{sub}")
        if self._fs.exists(at):
            for status in self._fs.listStatus(at):
                yield status.getPath().getName()

    def versions(self) -> list[int]:
        """The numbers of the published versions, ascending."""
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A published version, the last without a number; None before the first."""
        if number is None:
            known = self.versions()
            if not known:
                return None
            number = known[-1]
        return Version.read(self.spark.read.text(f"{self.folder}/versions/{number:09d}", wholetext=True).first()[0])

    def _publish(self, v: Version) -> Version:
        beside, at = self._path(f"{self.folder}/versions/_{uuid.uuid4().hex}"), self._path(f"{self.folder}/versions/{v.number:09d}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(asdict(v), sort_keys=True).encode()))
        out.close()
        plain = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(beside, at, plain)  # an error if the number is taken
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {v.number} is already published") from e
            raise
        return v

    # Reading

    def _rows(self, v: Version | None, buckets: list[int] | None = None) -> DataFrame:
        folders = [] if v is None else [f for b, f in v.folders.items() if buckets is None or b in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], manifest.SCHEMA)
        return self.spark.read.schema(manifest.SCHEMA).parquet(*[f"{self.folder}/{f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last without a number."""
        return self._rows(self.version(number))

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The rows of some URLs; only their buckets are read."""
        v = self.version()
        if v is None:
            return self._rows(None)
        keys = urls.select("url").distinct()
        return self._rows(v, self._touched(keys, v.buckets)).join(keys, "url", "left_semi")

    # Writing

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        return sorted(r[0] for r in rows.select(bucket_of(F.col("url"), buckets)).distinct().collect())  # at most the number of buckets

    def _write(self, rows: DataFrame, buckets: int) -> tuple[dict[int, str], dict[int, int]]:
        """Folders and sizes of the buckets that rows fill."""
        data = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", bucket_of(F.col("url"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "url")
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{data}")
        written = self.spark.read.parquet(f"{self.folder}/{data}") if any(n.startswith("bucket=") for n in self._names(data)) else None
        rows_of = {} if written is None else {int(r[0]): r[1] for r in written.groupBy("bucket").count().collect()}
        return {b: f"{data}/bucket={b}" for b in rows_of}, rows_of

    def _change(self, make: Callable[[DataFrame], DataFrame], keys: DataFrame, attempts: int, once: tuple[str, int] | None = None) -> Version | None:
        """A version in which the buckets of keys have the rows that make gives for their present ones."""
        for left in reversed(range(attempts)):
            now = self.version()
            if now is None:
                now = Version(0, self.buckets or max(1, -(-keys.count() // self.rows_per_bucket)))
            if once and now.merged.get(once[0], -1) >= once[1]:
                return now
            touched = self._touched(keys, now.buckets)
            if not touched and not once:
                return self.version()
            folders, rows = self._write(make(self._rows(now, touched)), now.buckets) if touched else ({}, {})
            kept = [{b: x for b, x in old.items() if b not in set(touched)} for old in (now.folders, now.rows)]
            try:
                return self._publish(Version(now.number + 1, now.buckets, kept[0] | folders, kept[1] | rows, now.merged | dict([once] if once else [])))
            except Conflict:
                if not left:
                    raise
        return None

    def merge(self, changes: DataFrame, attempts: int = 5, once: tuple[str, int] | None = None) -> Version | None:
        """Puts changes over the rows: of several of one URL the last fetched, then the one with the greater values; a conflict is merged again.

        Rows without a URL are left out.  No changes make no version.  once: a stream and the number of its batch; one that is
        merged already isn't merged again.
        """
        fresh = cut(last_of_each(manifest.lenient(changes.where("url != ''"))))
        return self._change(lambda old: manifest.upsert(old, fresh), fresh, attempts, once)

    def remove(self, urls: DataFrame, attempts: int = 5) -> Version | None:
        """Takes the rows of some URLs out."""
        gone = cut(urls.where("url != ''").select("url").distinct())
        return self._change(lambda old: manifest.remove(old, gone), gone, attempts)

    def resize(self) -> Version | None:
        """Deals all rows to as many buckets as they now need."""
        now = self.version()
        if now is None:
            return None
        buckets = max(1, -(-sum(now.rows.values()) // self.rows_per_bucket))
        if buckets == now.buckets:
            return now
        folders, rows = self._write(self._rows(now), buckets)
        return self._publish(Version(now.number + 1, buckets, folders, rows, now.merged))

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the last versions and the data that none of those names; returns how many folders of data went.

        What a merge is writing at that time isn't named yet: run it while none does.
        """
        known = self.versions()
        old, last = known[:-keep], [self.version(n) for n in known[-keep:]]
        named = {f.split("/")[1] for v in last for f in v.folders.values()}
        named_buckets = {f for v in last for f in v.folders.values()}
        for n in old:
            self._fs.delete(self._path(f"{self.folder}/versions/{n:09d}"), False)
        gone = 0
        for name in list(self._names("data")):
            if name not in named:
                gone += bool(self._fs.delete(self._path(f"{self.folder}/data/{name}"), True))
                continue
            for bucket in list(self._names(f"data/{name}")):
                if bucket.startswith("bucket=") and f"data/{name}/{bucket}" not in named_buckets:
                    gone += bool(self._fs.delete(self._path(f"{self.folder}/data/{name}/{bucket}"), True))
        return gone


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of the rows of each URL the last fetched, then the one with the greatest values in their order."""
    values = [f.name for f in manifest.SCHEMA if f.name not in ("url", "fetched_at")]
    best = rows.groupBy("url").agg(F.max(F.struct("fetched_at", *values)).alias("_best"))
    return best.select("url", "_best.*").select(*[f.name for f in manifest.SCHEMA])
