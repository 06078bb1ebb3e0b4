"""The manifest: a table of resources keyed by URL, its upkeep, joins and reports."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkloom.schemas import struct

SCHEMA = struct(
    "url string, path string, etag string, last_modified string, content_type string, sha256 string, note string, "
    "status int, size bigint, fetched_at bigint, depth int, kind string, state string"
)
FORMAT = 1
STATES, KINDS = ("done", "failed", "skipped"), ("html", "css", "js", "image", "font", "media", "manifest", "other")
_OPTIONAL = ("path", "etag", "last_modified", "content_type", "sha256", "note")


def lenient(rows: DataFrame) -> DataFrame:
    """Nulls and unknown names as their defaults: empty text, 0, done, other."""
    filled = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])
    values = {f.name: F.coalesce(F.col(f.name), F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)) for f in SCHEMA}
    values["state"] = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("done")
    values["kind"] = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("other")
    return filled.withColumns(values)


def to_json(manifest: DataFrame) -> DataFrame:
    """url and the JSON of each entry; empty optional fields are left out."""
    fields = [F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.name in _OPTIONAL else F.col(f.name) for f in SCHEMA if f.name != "url"]
    return manifest.select("url", F.to_json(F.struct(*fields)).alias("entry"))


def save_json(manifest: DataFrame, path: str) -> None:
    """One line for each entry, sorted by URL, under a format line; the form that load_json reads."""
    head = manifest.sparkSession.createDataFrame([("", f'{{"format":{FORMAT}}}')], "url string, entry string")
    lines = to_json(manifest).unionByName(head).select(F.to_json(F.struct("url", "entry")).alias("value"), "url")
    lines.sort("url").select("value").write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """The manifest in a folder that save_json wrote; an error if its format is newer."""
    rows = spark.read.text(path).select(F.from_json("value", "url string, entry string").alias("r")).select("r.*")
    newest = rows.where("url = ''").select(F.max(F.get_json_object("entry", "$.format").cast("int"))).first()[0]
    if newest is not None and newest > FORMAT:
        raise ValueError(f"manifest format {newest} is newer than {FORMAT}")
    entry = T.StructType([f for f in SCHEMA if f.name != "url"])
    return lenient(rows.where("url != ''").select("url", F.from_json("entry", entry).alias("e")).select("url", "e.*"))


def load_document(spark: SparkSession, file: str) -> tuple[dict, DataFrame]:
    """The header and the rows of a manifest in one JSON document (format, source, created_at, updated_at, entries by URL).

    A missing file is an empty manifest.  Such a document is held by one task; for large manifests use save_json's form.
    """
    import json

    entry = T.StructType([f for f in SCHEMA if f.name != "url"])
    whole = T.StructType().add("format", T.IntegerType()).add("source", T.StringType()).add("created_at", T.LongType()).add("updated_at", T.LongType()).add("entries", T.MapType(T.StringType(), entry))
    try:
        texts = spark.read.text(file, wholetext=True)
        broken = texts.where(F.try_parse_json("value").isNull()).count()
    except AnalysisException:
        return {}, lenient(spark.createDataFrame([], SCHEMA))
    if broken:
        raise ValueError(f"{file} is not valid JSON")
    parsed = texts.select(F.from_json("value", whole).alias("m"))
    head = json.loads(parsed.select(F.to_json(F.struct("m.format", "m.source", "m.created_at", "m.updated_at"))).first()[0])
    if head.get("format", 0) > FORMAT:
        raise ValueError(f"manifest format {head['format']} is newer than {FORMAT}")
    return head, lenient(parsed.select(F.explode("m.entries").alias("url", "e")).select("url", "e.*"))


def document_text(manifest: DataFrame, source: str, created_at: int = 0) -> DataFrame:
    """One row with the manifest as one JSON document, indented, entries sorted by URL; created_at 0 is now."""
    lines = to_json(manifest).agg(F.array_sort(F.collect_list(F.struct("url", F.from_json("entry", T.StructType([f for f in SCHEMA if f.name != "url"])).alias("e")))).alias("rows"))
    now = F.unix_timestamp()
    made = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(source).alias("source"), (F.lit(created_at) if created_at else now).alias("created_at"), now.alias("updated_at"),
        F.map_from_entries("rows").alias("entries"),
    )
    return lines.select(F.to_json(made, {"pretty": "true"}).alias("value"))


def save_document(manifest: DataFrame, file: str, source: str, created_at: int, updated_at: int) -> None:
    """Writes the document of document_text() as one file, sorted over all tasks: each writes its range's entries, and the files are joined behind a head.

    No task holds more than its range; rows of one URL are an error of the caller's, as keys would repeat.
    """
    from linkloom.session import shared_dir
    from linkloom.sources.files import join_files, remove_folder, write_parts

    spark, entry = manifest.sparkSession, T.StructType([f for f in SCHEMA if f.name != "url"])
    pretty = {"pretty": "true"}
    rows = to_json(manifest).select("url", F.from_json("entry", entry).alias("e"))
    whole = F.to_json(F.struct(F.create_map("url", "e").alias("entries")), pretty)
    opening, closing = '{\n  "entries" : {\n', "\n  }\n}"
    each = F.substring(whole, len(opening) + 1, F.length(whole) - len(opening) - len(closing))
    first = manifest.agg(F.min("url")).first()[0]
    lines = rows.select("url", F.concat(F.when(F.col("url") == F.lit(first), "").otherwise(",\n"), each).alias("value")).sort("url")
    made = F.struct(F.lit(FORMAT).alias("format"), F.lit(source).alias("source"), F.lit(created_at).alias("created_at"), F.lit(updated_at).alias("updated_at"), F.from_json(F.lit("{}"), T.MapType(T.StringType(), entry)).alias("entries"))
    empty = spark.range(1).select(F.to_json(made, pretty)).first()[0]
    if first is None:
        return join_files(spark, "", [], file, empty, "")
    folder = f"{shared_dir(spark)}/document-{uuid4().hex}"
    names = write_parts(lines, folder)
    join_files(spark, folder, names, file, empty[: empty.rindex("{") + 1] + "\n", closing)
    remove_folder(spark, folder)
    return None


def upsert(manifest: DataFrame, changes: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """manifest with changes put over it; the later of several changes to one URL (by fetched_at) wins.

    key: what tells rows apart, where a URL has several; null is a value of its own.
    """
    both = manifest.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("fetched_at"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def remove(manifest: DataFrame, urls: DataFrame) -> DataFrame:
    return manifest.join(urls.select("url"), "url", "left_anti")


def split_resume(frontier: DataFrame, manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frontier's URLs that are done and whose file exists, and those to fetch."""
    ready = manifest.where("state = 'done' and path != ''").join(files.select("path"), "path", "left_semi").select("url")
    return frontier.join(ready, "url", "left_semi"), frontier.join(ready, "url", "left_anti")


def conditional_headers(frontier: DataFrame, manifest: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """frontier with if_none_match and if_modified_since from done rows; null without a validator.

    key: what tells the manifest's rows apart, where a URL has several.
    """
    known = manifest.where("state = 'done'").select(*key, F.nullif("etag", F.lit("")).alias("if_none_match"), F.nullif("last_modified", F.lit("")).alias("if_modified_since"))
    return frontier.join(known, list(key), "left")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """key and change: added, removed, unchanged (validators or content agree), changed.

    key: what tells the rows of either side apart, where a URL has several.
    """
    o = old.select(*key, F.lit(True).alias("_o"), F.col("etag").alias("_oe"), F.col("sha256").alias("_os"))
    n = new.select(*key, F.lit(True).alias("_n"), F.col("etag").alias("_ne"), F.col("sha256").alias("_ns"))
    same = ((F.col("_oe") != "") & (F.col("_oe") == F.col("_ne"))) | (F.col("_os") == F.col("_ns"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return o.join(n, list(key), "full_outer").select(*key, change.alias("change"))


def check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """url, path and verdict of done rows, against files (path, sha256): missing, corrupted, unverifiable or verified."""
    f = files.select("path", F.col("sha256").alias("_found"))
    verdict = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("sha256") == "", "unverifiable").when(F.col("sha256") != F.col("_found"), "corrupted").otherwise("verified")
    )
    return manifest.where("state = 'done' and path != ''").join(f, "path", "left").select("url", "path", verdict.alias("verdict"))


def check_summary(checked: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return checked.agg(*map(n, ("verified", "missing", "corrupted", "unverifiable")), (F.count_if(F.col("verdict").isin("missing", "corrupted")) == 0).alias("ok"))


def by_kind(manifest: DataFrame) -> DataFrame:
    return manifest.where("state = 'done'").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def failures(manifest: DataFrame) -> DataFrame:
    return manifest.where("state = 'failed'").select("url", "status", "note")


def top_failures(manifest: DataFrame, n: int = 15) -> DataFrame:
    """The first n failures by URL, and more, how many there are besides."""
    every = failures(manifest)
    total = every.agg(F.count(F.lit(1)).alias("_total"))
    return every.orderBy("url").limit(n).crossJoin(F.broadcast(total)).select("url", "status", "note", F.greatest(F.col("_total") - n, F.lit(0)).alias("more"))  # one row


def top_problems(checked: DataFrame, n: int = 20) -> DataFrame:
    """The first n missing and the first n corrupted files of check() by path, and more, how many there are besides."""
    bad = checked.where("verdict in ('missing', 'corrupted')")
    totals = bad.groupBy("verdict").agg(F.count(F.lit(1)).alias("_total"))
    first = [bad.where(F.col("verdict") == v).orderBy("path", "url").limit(n) for v in ("missing", "corrupted")]
    return first[0].unionByName(first[1]).join(F.broadcast(totals), "verdict").select("url", "path", "verdict", F.greatest(F.col("_total") - n, F.lit(0)).alias("more"))  # two rows


def count_states(manifest: DataFrame) -> DataFrame:
    return manifest.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def total_bytes(manifest: DataFrame) -> DataFrame:
    return manifest.where("state = 'done'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def run_counters(events: DataFrame) -> DataFrame:
    """One row of counters from outcome (downloaded, reused, unchanged, skipped, failed), kind and bytes of each resource."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    got = F.col("outcome") == "downloaded"
    page: Column = F.col("kind") == "html"
    return events.agg(
        *map(n, ("downloaded", "reused", "unchanged", "skipped", "failed")),
        F.coalesce(F.sum(F.when(got, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(got & page).alias("pages"),
        F.count_if(got & ~page).alias("assets"),
    )


def run_summary(events: DataFrame, stop: str = "") -> DataFrame:
    """One row with the counters of a run, and why it stopped early if it did, as JSON."""
    counters = run_counters(events)
    return counters.select(F.to_json(F.struct(*counters.columns, F.lit(bool(stop)).alias("stopped_early"), *([F.lit(stop).alias("stop_reason")] if stop else []))).alias("summary"))


def path_collisions(manifest: DataFrame) -> DataFrame:
    """Paths that several URLs map to, of which only the last written survives."""
    return manifest.where("state = 'done' and path != ''").groupBy("path").agg(F.count(F.lit(1)).alias("urls")).where("urls > 1")
