"""Stored responses as a data source, "webpacks": packs of bodies with an index each, in a folder of published versions.

    responses.write.format("webpacks").option("path", folder).mode("append").save()
    spark.read.format("webpacks").option("path", folder).load().where("url = '...'")
    spark.readStream.format("webpacks").option("path", folder).load()

A task writes one pack (bodies one after the other) and one index (JSON lines with url, status, headers and the place of the body).  A job's
packs count when its commit renames the new version's file to its number; a job that fails leaves the last version as it was, and abort() removes
what it wrote.  A pack is a partition of a scan.  Filters on url choose packs by their least and greatest URL, and rows by the index, so a body
that isn't asked for is never read.  A stream's offset is a version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from linkloom.sources.files import open_store

SCHEMA = "url string, final_url string, status int, headers array<struct<name:string,value:string>>, body binary, truncated boolean, error string"
_INDEXED = ("url", "final_url", "status", "truncated", "error")


@dataclass
class Pack(WriterCommitMessage):
    """A pack of a version: its name, rows, and least and greatest URL."""

    name: str
    rows: int
    least: str
    most: str


class Folder:
    """The versions of a folder."""

    def __init__(self, path: str):
        self.store, self.top = open_store(path.rstrip("/"))

    def last(self) -> int:
        """The number of the last version; 0 before the first."""
        found = self.store.get_file_info(fs.FileSelector(f"{self.top}/versions", allow_not_found=True))
        return max((int(f.base_name) for f in found if f.base_name.isdigit()), default=0)

    def packs(self, version: int) -> list[Pack]:
        if not version:
            return []
        with self.store.open_input_stream(f"{self.top}/versions/{version:09d}") as f:
            return [Pack(**p) for p in json.loads(f.read())["packs"]]

    def publish(self, version: int, packs: list[Pack]) -> None:
        self.store.create_dir(f"{self.top}/versions", recursive=True)
        beside, at = f"{self.top}/versions/_{uuid.uuid4().hex}", f"{self.top}/versions/{version:09d}"
        with self.store.open_output_stream(beside, compression=None) as f:
            f.write(json.dumps({"packs": [vars(p) for p in packs]}).encode())
        if self.store.get_file_info(at).type != fs.FileType.NotFound:
            self.store.delete_file(beside)
            raise RuntimeError(f"another job has published version {version}")
        self.store.move(beside, at)


class WebPacks(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "webpacks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options["path"], int(self.options.get("version", 0)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"url", "body"} - set(schema.names)
        if missing:
            raise ValueError(f"rows need {', '.join(sorted(missing))}")
        return PackWriter(self.options["path"], overwrite)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PackStream(self.options["path"])


@dataclass
class PackPartition(InputPartition):
    name: str


class PackReader(DataSourceReader):
    def __init__(self, path: str, version: int):
        self.path, self.version, self.urls, self.prefix = path, version, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on url are answered here, others are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("url",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("url",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def _only(self, urls: set[str]) -> None:
        self.urls = urls if self.urls is None else self.urls & urls

    def _may_hold(self, p: Pack) -> bool:
        if self.prefix and not p.least[: len(self.prefix)] <= self.prefix <= p.most:
            return False
        return self.urls is None or any(p.least <= u <= p.most for u in self.urls)

    def partitions(self) -> list[PackPartition]:
        folder = Folder(self.path)
        found = [PackPartition(p.name) for p in folder.packs(self.version or folder.last()) if p.rows and self._may_hold(p)]
        return found or [PackPartition("")]

    def wanted(self, url: str | None) -> bool:
        if self.urls is not None and url not in self.urls:
            return False
        return not self.prefix or (url or "").startswith(self.prefix)

    def read(self, partition: PackPartition) -> Iterator[tuple]:
        if partition.name:
            yield from read_pack(self.path, partition.name, self.wanted)


def read_pack(path: str, name: str, wanted=lambda url: True) -> Iterator[tuple]:
    """The rows of a pack whose URL is wanted; bodies are read by their places."""
    folder = Folder(path)
    with folder.store.open_input_stream(f"{folder.top}/{name}.index", compression=None) as index, folder.store.open_input_file(f"{folder.top}/{name}.pack") as bodies:
        held = b""
        while chunk := index.read(1 << 20):
            *lines, held = (held + chunk).split(b"\n")
            for line in lines:
                r = json.loads(line)
                if wanted(r["url"]):
                    body = None if r["at"] is None else bodies.read_at(r["size"], r["at"])
                    headers = None if r["headers"] is None else [tuple(h) for h in r["headers"]]
                    yield r["url"], r["final_url"], r["status"], headers, body, r["truncated"], r["error"]


class PackWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.job = path, f"data/{uuid.uuid4().hex}"
        folder = Folder(path)
        self.version = folder.last()
        self.kept = [] if overwrite else folder.packs(self.version)

    def write(self, rows: Iterator) -> Pack:
        """One pack of a task; an attempt that is repeated writes another, which alone is named."""
        folder, name = Folder(self.path), f"{self.job}/{uuid.uuid4().hex}"
        folder.store.create_dir(f"{folder.top}/{self.job}", recursive=True)
        at, n, urls = 0, 0, ("", "")
        with folder.store.open_output_stream(f"{folder.top}/{name}.pack", compression=None) as bodies, folder.store.open_output_stream(f"{folder.top}/{name}.index", compression=None) as index:
            for row in rows:
                r = row.asDict()
                body = r.get("body")
                told = {k: r.get(k) for k in _INDEXED}
                told["headers"] = None if r.get("headers") is None else [list(h) for h in r["headers"]]
                told |= {"at": None if body is None else at, "size": len(body or b"")}
                index.write(json.dumps(told).encode() + b"\n")
                if body:
                    bodies.write(bytes(body))
                    at += len(body)
                url = told["url"] or ""
                urls = (min(urls[0], url), max(urls[1], url)) if n else (url, url)
                n += 1
        return Pack(name, n, *urls)

    def commit(self, messages: list[Pack | None]) -> None:
        Folder(self.path).publish(self.version + 1, self.kept + [m for m in messages if m is not None and m.rows])

    def abort(self, messages: list[Pack | None]) -> None:
        folder = Folder(self.path)
        if folder.store.get_file_info(f"{folder.top}/{self.job}").type != fs.FileType.NotFound:
            folder.store.delete_dir(f"{folder.top}/{self.job}")


class PackStream(DataSourceStreamReader):
    """The packs that versions add, in their order."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": Folder(self.path).last()}

    def partitions(self, start: dict, end: dict) -> list[PackPartition]:
        folder = Folder(self.path)
        before = {p.name for p in folder.packs(start["version"])}
        return [PackPartition(p.name) for p in folder.packs(end["version"]) if p.name not in before] or [PackPartition("")]

    def read(self, partition: PackPartition) -> Iterator[tuple]:
        if partition.name:
            yield from read_pack(self.path, partition.name)

    def commit(self, end: dict) -> None:
        pass
