"""Files in folders that tasks read and write themselves: whole or not at all."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.paths import is_inside


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def ensure_folder(spark: SparkSession, folder: str) -> bool:
    store, path = _hadoop(spark, folder)
    return store.mkdirs(path)


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Whether there was one."""
    store, path = _hadoop(spark, folder)
    return store.delete(path, True)


def inside(path: Column) -> Column:
    """Whether a relative path stays in the folder that it is relative to."""
    return is_inside(F.lit("/r"), F.concat(F.lit("/r/"), path))


def write_files(rows: DataFrame, folder: str, path: str = "path", body: str = "body") -> DataFrame:
    """Writes a file for each row (a relative path and a binary body) and returns path, size and sha256 of each, computed already.

    A task writes a file beside its place and renames it when it is whole, so a file is the old or the new one at any time and
    a repeated attempt does no harm.  Paths that lead out of the folder are refused with an error.  Of rows with one path the one with the
    greatest hash is written, and it alone is returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        made: set[str] = set()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # one body at a time
                name, data = batch.column("path")[k].as_py(), batch.column("body")[k].as_py() or b""
                if not batch.column("inside")[k].as_py():
                    raise ValueError(f"{name} leads out of the folder")
                at = f"{top}/{name}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                beside = f"{parent}/_{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(beside, compression=None) as f:
                    f.write(data)
                store.move(beside, at)
                out.append((name, len(data), hashlib.sha256(data).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["path", "size", "sha256"])

    told = rows.select(F.col(path).alias("path"), F.col(body).cast("binary").alias("body"), inside(F.col(path)).alias("inside"))
    twice = told.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    if not twice.isEmpty():  # bodies are shuffled for such paths only
        shared = told.join(twice, "path", "left_semi").groupBy("path").agg(F.max(F.struct(F.sha2("body", 256), "body", "inside")).alias("r")).select("path", "r.body", "r.inside")
        told = told.join(twice, "path", "left_anti").unionByName(shared)
    spark = rows.sparkSession
    ensure_folder(spark, folder)
    written = told.mapInArrow(run, "path string, size long, sha256 string")
    listing = f"{folder.rstrip('/')}/.mirror/written-{uuid.uuid4().hex}"
    written.write.parquet(listing)
    return spark.read.schema("path string, size long, sha256 string").parquet(listing)


def read_files(spark: SparkSession, folder: str, content: bool = False, hidden: bool = False) -> DataFrame:
    """path (relative, / between parts), size and, if asked for, body of all files under a folder; a missing folder has none.

    Files are listed by Spark; hidden ones, whose names or folders begin with a dot, are left out unless asked for.
    """
    store, root = _hadoop(spark, folder)
    schema = "path string, size long" + (", body binary" if content else "")
    if not store.exists(root):
        return spark.createDataFrame([], schema)
    top = store.makeQualified(root).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substring(F.regexp_replace("path", "^file:/+", "file:///") if top.startswith("file:") else F.col("path"), len(re.sub("^file:/+", "file:///", top)) + 2, 1 << 20)
    rows = rows.select(relative.alias("path"), F.col("length").alias("size"), *([F.col("content").alias("body")] if content else []))
    return rows if hidden else rows.where(~F.col("path").rlike(r"(^|/)\."))


def list_files(spark: SparkSession, folder: str, hidden: bool = False, tasks: int = 64) -> DataFrame:
    """path (relative) and size of all files under a folder, listed by tasks: each takes subtrees, and holds one folder's names at a time.

    The driver lists folders, level by level, only until there are as many as tasks.  Hadoop's checksum files (.name.crc) are no files.
    """
    store, root = _hadoop(spark, folder)
    schema = "path string, size long"
    if not store.exists(root):
        return spark.createDataFrame([], schema)
    found: list[tuple[str, int]] = []
    trees, shown = [""], (lambda name: not name.startswith(".") or (hidden and not name.endswith(".crc")))
    while trees and len(trees) < tasks:
        below = []
        for tree in trees:
            for s in store.listStatus(root if not tree else spark._jvm.org.apache.hadoop.fs.Path(root, tree)):
                name = s.getPath().getName()
                if shown(name):
                    at = f"{tree}/{name}" if tree else name
                    below.append(at) if s.isDirectory() else found.append((at, s.getLen()))
        trees = below
    top_uri = store.makeQualified(root).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_store(top_uri)
        for batch in batches:
            todo = batch.column("path").to_pylist()
            while todo:
                tree, names, sizes = todo.pop(), [], []
                for f in files.get_file_info(fs.FileSelector(f"{top}/{tree}")):
                    if not shown(f.base_name):
                        continue
                    at = f"{tree}/{f.base_name}" if tree else f.base_name
                    if f.type == fs.FileType.Directory:
                        todo.append(at)
                    else:
                        names.append(at)
                        sizes.append(f.size)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["path", "size"])

    listed = spark.createDataFrame(found, schema)
    if not trees:
        return listed
    deep = spark.createDataFrame([(t,) for t in trees], "path string").repartition(min(len(trees), tasks), "path").mapInArrow(run, schema)
    return listed.unionByName(deep)


def hash_files(spark: SparkSession, folder: str, hidden: bool = False, tasks: int = 64) -> DataFrame:
    """path, size and sha256 of all files under a folder; tasks read them by 64 KiB, so no body is ever in a row or held whole.

    A file that is gone by then, or can't be read, is left out.
    """
    store, root = _hadoop(spark, folder)
    top_uri = store.makeQualified(root).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_store(top_uri)
        for batch in batches:
            out = []
            for name in batch.column("path").to_pylist():
                found, size = hashlib.sha256(), 0
                try:
                    with files.open_input_stream(f"{top}/{name}", compression=None) as f:
                        while chunk := f.read(64 << 10):
                            found.update(chunk)
                            size += len(chunk)
                except OSError:
                    continue
                out.append((name, size, found.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["path", "size", "sha256"])

    listed = list_files(spark, folder, hidden, tasks).select("path")
    return listed.repartition(tasks, "path").mapInArrow(run, "path string, size long, sha256 string")


def read_chunks(spark: SparkSession, folder: str, size: int = 1 << 20, hidden: bool = False, tasks: int = 64) -> DataFrame:
    """path, chunk and bytes of all files under a folder, in chunks of up to size bytes that tasks read one at a time.

    An empty file is one empty chunk; a file that is gone by then is left out.
    """
    store, root = _hadoop(spark, folder)
    top_uri = store.makeQualified(root).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_store(top_uri)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    stream = files.open_input_stream(f"{top}/{name}", compression=None)
                except FileNotFoundError:
                    continue
                with stream as f:
                    n, chunk = 0, f.read(size)
                    while chunk or not n:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([chunk], pa.binary())], names=["path", "chunk", "bytes"])
                        n, chunk = n + 1, f.read(size)

    listed = list_files(spark, folder, hidden, tasks).select("path")
    return listed.repartition(tasks, "path").mapInArrow(run, "path string, chunk int, bytes binary")


def sorted_files(files: DataFrame) -> DataFrame:
    """Files in the order of their paths."""
    return files.orderBy("path")


def write_parts(lines: DataFrame, folder: str, text: str = "value") -> list[str]:
    """Writes each partition's texts, one after the other, as one file of the folder; their names in the partitions' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        name, part = f"part-{uuid.uuid4().hex}", None
        with store.open_output_stream(f"{top}/{name}", compression=None) as f:
            for batch in batches:
                for k in range(batch.num_rows):
                    part = batch.column("part")[0].as_py()
                    f.write(batch.column("value")[k].as_buffer())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], names=["part", "name"])

    told = lines.select(F.spark_partition_id().alias("part"), F.col(text).alias("value")).mapInArrow(run, "part int, name string")
    return [r["name"] for r in sorted(told.collect())]  # a row for each partition


def join_files(spark: SparkSession, folder: str, names: list[str], file: str, head: str, tail: str) -> None:
    """One file of a head, the named files of a folder and a tail, copied by streams in the JVM and renamed when it is whole."""
    store, at = _hadoop(spark, file)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{file}.{uuid.uuid4().hex}.tmp")
    out = store.create(beside, True)
    out.write(bytearray(head.encode()))
    for name in names:
        given, part = _hadoop(spark, f"{folder}/{name}")
        stream = given.open(part)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.write(bytearray(tail.encode()))
    out.close()
    store.delete(at, False)
    if not store.rename(beside, at):
        raise OSError(f"{file} can't be put in its place")
