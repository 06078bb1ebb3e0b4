"""Stored responses: header blocks, files in folders, and where bodies go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import iequals, trim


def parse_headers(text: Column) -> Column:
    """An array of name and value structs, in order and with repeats; status lines of all hops are left out."""
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit("HTTP/")))
    return F.transform(lines, lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("name"), trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def find_header(headers: Column, name: str) -> Column:
    """The value of the first header of a name in any case; empty without one."""
    hit = F.filter(headers, lambda h: iequals(h["name"], F.lit(name)))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(""))


def files_in(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path (relative, / between parts), size and, if asked for, sha256 of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1].replace("file:", "")
    relative = F.regexp_replace(F.col("path"), F.lit("^.*?" + "".join("\\" + c if not c.isalnum() else c for c in root) + "/+"), F.lit(""))
    extra = [F.sha2("content", 256).alias("sha256")] if content else []
    return rows.select(relative.alias("path"), F.col("length").alias("size"), *extra)


def folder_stats(files: DataFrame, *folder: str) -> DataFrame:
    """The number of files and their bytes, of all or for each folder."""
    return files.groupBy(*folder).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def needs_rewriting(kind: Column) -> Column:
    return kind.isin("html", "css", "manifest")


def route_bodies(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resources to keep raw until they are rewritten, and those to write at once."""
    return resources.where(needs_rewriting(F.col("kind"))), resources.where(~needs_rewriting(F.col("kind")))
