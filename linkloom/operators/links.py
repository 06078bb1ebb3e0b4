"""From bodies to edges: scan, resolve, keep what can be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.functions.text import computed, let
from linkloom.operators.scan import scan_css, scan_references


def effective_base(document: Column, base_href: Column) -> Column:
    """A parsed document URL, or the base it declares if that resolves to http."""
    declared = lambda d: F.when(F.coalesce(base_href, F.lit("")) != "", U.resolve(d, base_href))
    return let(document, lambda d: let(declared(d), lambda b: F.when(b.isNotNull() & U.is_http(b), b).otherwise(d)))


def html_references(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """pages without the body, with link, part, offset, role, hint, ref and target (parsed; null if it doesn't resolve to http).

    Each page is scanned once; its body goes no further.
    """
    keep = [c for c in pages.columns if c != body]
    # Fields of their own: for a generator over a field of the struct Spark loses the other one where the URL is a constant.
    scanned = pages.select(*keep, scan_references(F.col(body)).alias("_scan")).select(*keep, F.col("_scan.base_href").alias("_href"), F.col("_scan.refs").alias("_refs"))
    based = computed(scanned, "_base", effective_base(U.parse(F.col(url)), F.col("_href")))
    # An outer explode: for an inner one Spark puts a test of the array's size below it, and scans each page twice.
    rows = based.select(*keep, "_base", F.explode_outer("_refs").alias("_r")).where("_r is not null").select(*keep, "_base", "_r.*")
    target = F.when(~U.is_non_fetchable(F.col("ref")), U.resolve(F.col("_base"), F.col("ref")))
    return computed(rows, "target", let(target, lambda t: F.when(t.isNotNull() & U.is_http(t), t))).drop("_base")


def discover_html(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Edges: pages without the body, with link, part, role (nested references are assets), hint and target."""
    refs = html_references(pages, url, body).where("role != 'base' and target is not null")
    role = F.when(F.col("role") == "meta_refresh", "navigation").when(F.col("role") == "navigation", "navigation").otherwise("asset")
    return refs.withColumn("role", role).drop("offset", "length", "at", "size", "ref", "descriptor")


def discover_css(sheets: DataFrame, url: str = "url", body: str = "css") -> DataFrame:
    """Edges of style sheets: imports are css, the rest of unknown kind."""
    keep = [c for c in sheets.columns if c != body]
    rows = sheets.select(*keep, F.posexplode_outer(scan_css(F.col(body))).alias("link", "_l")).where("_l is not null")
    target = let(F.when(~U.is_non_fetchable(F.col("_l.value")), U.resolve(U.parse(F.col(url)), F.col("_l.value"))), lambda t: F.when(t.isNotNull() & U.is_http(t), t))
    hint = F.when(F.col("_l.is_import"), "css").otherwise("other")
    out = computed(rows, "target", target).select(*keep, "link", F.lit("asset").alias("role"), hint.alias("hint"), "target")
    return out.where("target is not null")
