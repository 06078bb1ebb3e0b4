"""Rewriting documents: every reference joined to the manifest, and the bodies spliced by byte offset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import url as U
from linkloom.functions.codec import encode_attribute_text
from linkloom.functions.paths import relative_link
from linkloom.functions.text import computed, let
from linkloom.operators.links import html_references
from linkloom.operators.scan import scan_css


def splice(body: bytes, replacements: list[tuple[int, int, bytes]]) -> bytes:
    """body with (offset, length, text) put in by offset; one that starts inside an earlier one is skipped."""
    out, at = [], 0
    for offset, length, text in sorted(replacements, key=lambda r: r[0]):
        if offset >= at:
            out += [body[at:offset], text]
            at = offset + length
    return b"".join([*out, body[at:]])


def _css_text(s: str) -> bytes:
    return s.replace("\\", "\\\\").replace('"', '\\"').encode()


def rewritten(html: bytes, refs: list[dict]) -> bytes:
    """html with the text of each reference's new, where it isn't null; refs as scan_references gives them."""
    from linkloom.functions.codec import decode_entities_text

    todo = []
    for _, parts in groupby(sorted(refs, key=lambda r: (r["link"], r["part"])), key=lambda r: r["link"]):
        parts = list(parts)
        offset, length, role = (parts[0][k] for k in ("offset", "length", "role"))
        if role == "base":
            todo.append((offset, length, b"./"))
        elif all(p["new"] is None for p in parts):
            continue
        elif role in ("style_block", "inline_style"):
            block = role == "style_block"
            css = html[offset : offset + length] if block else decode_entities_text(html[offset : offset + length].decode("utf-8", "replace")).encode()
            new = splice(css, [(p["at"], p["size"], _css_text(p["new"])) for p in parts if p["new"] is not None])
            if new != css:
                todo.append((offset, length, new if block else encode_attribute_text(new.decode("utf-8", "replace")).encode()))
        elif role == "srcset":
            todo.append((offset, length, encode_attribute_text(", ".join(f"{p['ref'] if p['new'] is None else p['new']} {p['descriptor']}".rstrip(" ") for p in parts)).encode()))
        else:
            todo.append((offset, length, encode_attribute_text(parts[0]["new"]).encode()))
    return splice(html, todo)


def localise(refs: DataFrame, manifest: DataFrame, document_path: str = "document_path") -> DataFrame:
    """refs (target, document_path) with new, the text a reference becomes (null: it stays), and outcome.

    A target that the manifest has a file for becomes a relative link; other targets become absolute.
    """
    known = manifest.where("state = 'done' and path != ''").select(F.col("url").alias("_key"), F.col("path").alias("_path"))
    keyed = computed(refs, "_target_key", U.url_key(F.col("target")))
    joined = keyed.join(known, F.col("_target_key") == F.col("_key"), "left")
    fragment = F.coalesce(F.concat(F.lit("#"), F.nullif(F.col("target.fragment"), F.lit(""))), F.lit(""))
    new: Column = F.when(F.col("target").isNull(), None).when(F.col("_path").isNotNull(), F.concat(relative_link(F.col(document_path), F.col("_path")), fragment)).otherwise(U.to_text(F.col("target")))
    base = F.col("role") == "base" if "role" in refs.columns else F.lit(False)
    outcome = F.when(base, "localised").when(F.col("target").isNull(), "untouched").when(F.col("_path").isNotNull(), "localised").otherwise("absolutised")
    return joined.withColumns({"new": new, "outcome": outcome}).drop("_key", "_path", "_target_key")


_REF = "array<struct<link:int,part:int,offset:int,length:int,role:string,at:int,size:int,ref:string,descriptor:string,new:string>>"


@F.pandas_udf(T.StringType())
def _rewrite_html(body: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, refs in body:
        yield pd.Series([None if h is None else rewritten(h.encode(), [] if r is None else list(r)).decode("utf-8", "replace") for h, r in zip(html, refs)])


def rewrite_html(pages: DataFrame, manifest: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", path: str = "document_path") -> DataFrame:
    """pages with content, the rewritten body, and localised, absolutised and untouched, the counts of its references.

    Only references travel to the manifest; bodies are joined to their own references by key at the end.
    """
    refs = localise(html_references(pages.select(key, url, path, body), url, body), manifest, path)
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    fields = ["link", "part", "offset", "length", "role", "at", "size", "ref", "descriptor", "new"]
    grouped = refs.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*fields)).cast(_REF).alias("_refs"), *map(n, ("localised", "absolutised", "untouched")))  # at most a page's own
    joined = pages.join(grouped, F.col(key) == F.col("_key"), "left").withColumn("content", _rewrite_html(F.col(body), F.col("_refs")))
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("localised", "absolutised", "untouched")}).drop("_key", "_refs")


@F.pandas_udf(T.StringType())
def _rewrite_css(css: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else splice(c.encode(), [(x["offset"], x["length"], _css_text(x["new"])) for x in (links_ if links_ is not None else []) if x["new"] is not None]).decode("utf-8", "replace") for c, links_ in zip(css, links)])


def rewrite_css(sheets: DataFrame, manifest: DataFrame, key: str = "sheet_id", url: str = "url", body: str = "css", path: str = "document_path") -> DataFrame:
    """As rewrite_html, for style sheets."""
    links = sheets.select(key, url, path, F.explode_outer(scan_css(F.col(body))).alias("_l")).where("_l is not null").select(key, url, path, "_l.*")
    target = F.when(~U.is_non_fetchable(F.col("value")), U.resolve(U.parse(F.col(url)), F.col("value")))
    refs = localise(computed(links, "target", let(target, lambda t: F.when(U.is_http(t), t))), manifest, path)
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    grouped = refs.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("offset", "length", "new")).alias("_links"), *map(n, ("localised", "absolutised", "untouched")))
    joined = sheets.join(grouped, F.col(key) == F.col("_key"), "left").withColumn("content", _rewrite_css(F.col(body), F.col("_links")))
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("localised", "absolutised", "untouched")}).drop("_key", "_links")


def refresh_manifest(manifest: DataFrame, rewritten_pages: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """manifest with the size and hash of what was written for rewritten pages (key and content).

    key: what tells rows apart, where a URL has several; a rewritten page is the only one of its key.
    """
    new = rewritten_pages.select(*key, F.octet_length("content").cast("long").alias("_size"), F.sha2(F.encode("content", "UTF-8"), 256).alias("_hash"))
    joined = manifest.join(new, list(key), "left")
    refreshed = joined.withColumns({"size": F.coalesce("_size", "size"), "sha256": F.coalesce("_hash", "sha256")})
    return refreshed.select(*manifest.columns)
