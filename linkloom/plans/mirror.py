"""The whole mirror over a table of stored responses: discover, scope, expand, classify, map, rewrite, write, report.

Edges are found once for all stored bodies and cut; the frontier then is joins of keys only.  Links can be made local when the
outcome of their targets is known, so the manifest is materialised before the rewriting joins to it.  Rows travel without bodies; a
body meets its row again only to be rewritten or written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import classify, paths
from linkloom.functions import url as U
from linkloom.operators import frontier, links, manifest, rewrite, scope
from linkloom.operators.scan import parse_robots
from linkloom.session import cut
from linkloom.sources.files import hash_files, inside, list_files, read_files, write_files
from linkloom.sources.responses import find_header, needs_rewriting, route_bodies

MANIFEST, RAW = ".mirror/manifest", ".mirror/raw"


@dataclass(frozen=True)
class Stored:
    """What an earlier run left: its manifest, the unrewritten bodies (raw_path, body) and the paths of its files."""

    manifest: DataFrame
    raw: DataFrame
    files: DataFrame


@dataclass(frozen=True)
class Mirror:
    """manifest: its rows; pages, sheets: rewritten bodies (url, path, content, localised); binaries, raw: bodies to write as they
    are (path, body); events: outcomes, for run_counters(); stop_reason: why the run stopped early, or empty."""

    manifest: DataFrame
    pages: DataFrame
    sheets: DataFrame
    binaries: DataFrame
    raw: DataFrame
    events: DataFrame
    stop_reason: str


def robots_rules(responses: DataFrame, agent: str) -> DataFrame:
    """origin, pattern and allow from the robots.txt files among responses; origins without one allow all."""
    found = responses.where(F.col("url").endswith("/robots.txt") & F.col("status").between(200, 299))
    text = F.make_valid_utf8(F.substring("body", 1, 512 << 10).cast("string"))
    rules = found.select(U.origin(U.parse(F.col("url"))).alias("origin"), parse_robots(agent)(text).alias("_r")).select("origin", F.explode("_r.rules").alias("_r"))
    return rules.select("origin", "_r.pattern", "_r.allow")


def resources(responses: DataFrame, s: scope.Scope, stored: Stored | None = None, update: bool = False) -> DataFrame:
    """A row for each URL that could be taken: outcome and note, by_name (its kind, but for how it was reached), what the manifest tells of it, and its body.

    A URL whose earlier file is still there is reused, unless update asks for it anew; then a 304 leaves it unchanged.  Both
    have the earlier row and the body that was kept for rewriting.
    """
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))
    header = {k: find_header(F.col("headers"), n) for k, n in (("type_header", "content-type"), ("etag", "etag"), ("last_modified", "last-modified"))}
    r = responses.select("url", final.alias("base"), "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "body", *[c.alias(k) for k, c in header.items()])
    size = F.coalesce(F.octet_length("body").cast("long"), F.lit(0))
    r = r.withColumns({"size": size, "content_type": classify.essence(F.col("type_header")), "by_name": classify.classify(F.col("type_header"), U.parse(F.col("base"))["path"], F.lit(""))})
    told = classify.outcome(F.col("status"), F.col("error"), F.col("truncated") | (size > s.max_file_size))
    r = r.withColumn("_o", told)
    state = F.when(F.col("_o.state") == "done", "downloaded").when(F.col("_o.state") == "unchanged", "failed").otherwise(F.col("_o.state"))
    note = F.when(F.col("_o.state") == "unchanged", classify.status_phrase(F.col("status"))).otherwise(F.col("_o.note"))
    r = r.withColumns({"outcome": state, "note": note, "sha256": F.sha2("body", 256)}).drop("_o", "error", "truncated", "type_header")
    none = {"c_path": "string", "c_kind": "string", "fetched_at": "long"}
    if stored is None:
        return r.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    raw_path = paths.raw_copy_path(F.col("url"), F.col("kind"))
    known = stored.manifest.where("state = 'done' and path != ''").withColumn("_raw", F.when(needs_rewriting(F.col("kind")), raw_path))
    known = known.join(stored.files.select(F.col("path").alias("_file"), F.lit(True).alias("_there")), F.col("path") == F.col("_file"), "left")
    known = known.join(stored.raw.select(F.col("raw_path").alias("_at"), F.col("body").alias("_body")), F.col("_raw") == F.col("_at"), "left")
    own = ("path", "kind", "status", "size", "content_type", "etag", "last_modified", "sha256", "fetched_at")
    known = known.select(F.col("url").alias("_url"), F.struct(*own, F.coalesce("_there", F.lit(False)).alias("there"), F.col("_body").alias("body")).alias("c"))
    both = r.join(known, F.col("url") == F.col("_url"), "full_outer")
    reused = F.col("c").isNotNull() & F.col("c.there") & F.lit(not update)
    unchanged = F.col("c").isNotNull() & (F.col("status") == 304) & (F.coalesce("outcome", F.lit("")) == "failed")
    old = F.coalesce(reused | unchanged, F.lit(False))
    pick = lambda new, c: F.when(F.col("_old"), F.col(f"c.{c}")).otherwise(F.col(new)).alias(new)
    both = both.withColumns({"_old": old, "_how": F.when(reused, "reused").otherwise("unchanged"), "_key": F.coalesce("url", "_url")}).where("_old or url is not null")
    return both.select(
        F.col("_key").alias("url"), F.when(F.col("_old"), F.col("_key")).otherwise(F.col("base")).alias("base"),
        *[pick(c, c) for c in ("status", "body", "etag", "last_modified", "size", "content_type", "sha256")],
        pick("by_name", "kind"), F.when(F.col("_old"), F.col("_how")).otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("_old"), "").otherwise(F.col("note")).alias("note"),
        F.when(F.col("_old") | (F.col("outcome") == "failed"), F.col("c.path")).alias("c_path"), F.when(F.col("_old"), F.col("c.kind")).alias("c_kind"), F.when(F.col("_old"), F.col("c.fetched_at")).alias("fetched_at"),
    )


_TAKEN = "outcome in ('downloaded', 'reused', 'unchanged')"


def edges_of(taken: DataFrame) -> DataFrame:
    """src, dst, target, role, pos and if_role of the bodies that are kept; references resolve against the final URL.

    A body of unknown kind is a page if navigation leads to it (if_role), and else leads nowhere.
    """
    r = taken.where(_TAKEN).withColumn("_text", F.make_valid_utf8(F.col("body").cast("string"))).select("url", "base", "by_name", "_text")
    if_role = F.when(F.col("by_name") == "other", "navigation").alias("if_role")
    html = links.discover_html(r.where("by_name in ('html', 'other')").select("url", "base", "by_name", "_text"), "base", "_text").select("url", "target", "role", "link", "part", if_role)
    css = links.discover_css(r.where("by_name = 'css'").select("url", "base", "_text"), "base", "_text").select("url", "target", "role", "link", F.lit(0).alias("part"), F.lit(None).cast("string").alias("if_role"))
    both = html.unionByName(css)
    return both.select(F.col("url").alias("src"), U.url_key(F.col("target")).alias("dst"), "target", "role", (F.col("link") * 1000 + F.col("part")).alias("pos"), "if_role")


def refused(rows: DataFrame, rules: DataFrame | None, s: scope.Scope) -> DataFrame:
    """rows (target, role, _depth) with the reason for which their target isn't taken, by scope and robots rules."""
    rows = scope.with_scope(rows, "target", "role", "_depth", s)
    if rules is None:
        return rows
    rows = rows.withColumns({"origin": U.origin(F.col("target")), "path": F.concat("target.path", F.coalesce(F.concat(F.lit("?"), "target.query"), F.lit("")))})
    rows = scope.robots_allowed(rows, rules)
    return rows.withColumn("reason", F.coalesce("reason", F.when(~F.col("allowed"), "disallowed by robots.txt")))


def reach(taken: DataFrame, responses: DataFrame, start: str, s: scope.Scope, agent: str) -> DataFrame:
    """What the start leads to, as frontier.expand gives it; refused URLs, the start among them, have the reason."""
    rules = cut(robots_rules(responses, agent)) if s.respect_robots else None
    # Depth is left to the frontier.
    edges = refused(edges_of(taken).withColumn("_depth", F.lit(1)), rules, s)
    edges = cut(edges.select("src", "dst", "role", "pos", "if_role", "reason"))
    seed = taken.sparkSession.createDataFrame([(start,)], "raw string").select(U.normalise_target(F.col("raw")).alias("target"), F.lit("navigation").alias("role"), F.lit(0).alias("_depth"))
    seed = refused(seed, rules, s).select(U.url_key(F.col("target")).alias("url"), "reason")
    return frontier.expand(seed, edges, s.max_depth if s.recursive else 0)


def list_urls(responses: DataFrame, start: str, s: scope.Scope, agent: str = "linkloom") -> DataFrame:
    """The URLs that a run would take, in the order in which it would; nothing is kept."""
    s = scope.Scope(**{**s.__dict__, "primary": s.primary or start})
    return reach(resources(responses, s), responses, start, s, agent).where("reason is null").orderBy("round", "parent", "url").select("url")


def mirror(responses: DataFrame, start: str, s: scope.Scope, agent: str = "linkloom", rewrite_links: bool = True, stored: Stored | None = None, update: bool = False) -> Mirror:
    """responses: url (its key), final_url, status, headers, body, truncated, error.  stored: an earlier run to go on from, or to update."""
    s = scope.Scope(**{**s.__dict__, "primary": s.primary or start})
    taken = resources(responses, s, stored, update)
    reached = reach(taken, responses, start, s, agent)

    light = reached.join(taken.drop("body", "base").withColumnRenamed("note", "_note"), "url", "left")
    refused = F.col("reason").isNotNull()
    light = light.withColumns({"outcome": F.when(refused, "skipped").otherwise(F.coalesce("outcome", F.lit("failed"))), "note": F.coalesce("reason", "_note", F.lit("not stored")), "size": F.coalesce("size", F.lit(0))})
    light = cut(scope.within_budget(light, "size", ["round", "parent", "url"], s, counts=F.expr(_TAKEN) & ~refused))
    stopped = light.where("stop is not null and reason is null").orderBy("round", "parent", "url").select(scope.stop_message(F.col("stop"), s).alias("why")).first()
    light = light.where("stop is null")
    navigated = F.when((F.col("by_name") == "other") & (F.col("role") == "navigation"), "html").otherwise(F.coalesce("by_name", F.lit("other")))
    rows = light.withColumn("kind", F.coalesce("c_kind", navigated))
    mapped = F.when(F.col("outcome") == "downloaded", paths.relative_path(U.parse(F.col("url")), F.col("kind"), U.parsed(s.primary))).otherwise(F.coalesce("c_path", F.lit("")))
    rows = rows.withColumn("path", mapped)
    out = F.col("outcome").isin("downloaded") & ~inside(F.col("path"))
    rows = rows.withColumns({"note": F.when(out, "path escapes the output directory").otherwise(F.col("note")), "outcome": F.when(out, "skipped").otherwise(F.col("outcome"))})
    state = F.when(F.expr(_TAKEN), "done").otherwise(F.col("outcome"))
    keep = lambda c: F.when(F.expr(_TAKEN), F.col(c))
    rows = rows.withColumn("state", state).withColumns({"sha256": keep("sha256"), "etag": keep("etag"), "last_modified": keep("last_modified"), "content_type": keep("content_type"), "path": F.when(F.col("state") == "skipped", "").otherwise(F.col("path"))})
    kind = F.when(F.col("state") == "done", F.col("kind")).otherwise("other")
    rows = cut(rows.withColumns({"kind": kind, "size": F.when(F.expr(_TAKEN), F.col("size")).otherwise(0)}).drop("reason", "_note", "stop", "by_name", "c_path", "c_kind"))
    entries = manifest.lenient(rows)
    if stored is not None:  # rows of an earlier run that this one did not come to stay
        entries = manifest.upsert(manifest.lenient(stored.manifest), entries)

    bodies = taken.where(_TAKEN).select("url", "base", "body").join(rows.where("state = 'done'").select("url", "path", "kind", "outcome"), "url")
    texts, binaries = route_bodies(bodies)
    binaries = binaries.where("outcome = 'downloaded'").select("path", "body")
    raw = texts.where("outcome = 'downloaded'").select(paths.raw_copy_path(F.col("url"), F.col("kind")).alias("path"), "body")
    texts = texts.select("url", "base", "path", "kind", F.make_valid_utf8(F.col("body").cast("string")).alias("text"))
    html, css = texts.where("kind = 'html'"), texts.where("kind = 'css'")
    plain = lambda df: df.select("url", "path", F.col("text").alias("content"), F.lit(0).cast("long").alias("localised"))
    events = rows.select("outcome", "kind", F.col("size").alias("bytes"))
    if rewrite_links:
        pages = rewrite.rewrite_html(html, entries, "url", "base", "text", "path").select("url", "path", "content", "localised")
        sheets = rewrite.rewrite_css(css, entries, "url", "base", "text", "path").select("url", "path", "content", "localised").unionByName(plain(texts.where("kind = 'manifest'")))
    else:
        pages, sheets = plain(html), plain(texts.where("kind in ('css', 'manifest')"))
    done = cut(pages.withColumn("_page", F.lit(True)).unionByName(sheets.withColumn("_page", F.lit(False))))
    entries = rewrite.refresh_manifest(entries, done)
    return Mirror(entries, done.where("_page").drop("_page"), done.where("not _page").drop("_page"), binaries, raw, events, stopped.why if stopped else "")


def write_mirror(m: Mirror, folder: str) -> DataFrame:
    """Writes the files of a mirror, the bodies that a later run needs, and the manifest; path, size and sha256 of what was written."""
    texts = m.pages.unionByName(m.sheets).select("path", F.encode("content", "UTF-8").alias("body"))
    told = write_files(texts.unionByName(m.binaries).unionByName(m.raw), folder)
    manifest.save_json(m.manifest, f"{folder.rstrip('/')}/{MANIFEST}")
    return told


def read_mirror(spark: SparkSession, folder: str) -> Stored:
    """What write_mirror left in a folder."""
    at = folder.rstrip("/")
    raw = read_files(spark, f"{at}/{RAW}", content=True).select(F.concat(F.lit(f"{RAW}/"), "path").alias("raw_path"), "body")
    return Stored(cut(manifest.load_json(spark, f"{at}/{MANIFEST}")), raw, list_files(spark, folder).select("path"))


def check_mirror(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What became of the files of a mirror's folder: url, path and verdict of each, hashed where they lie; and one row with the counts and ok.

    An error without a manifest there, as nothing can be checked.
    """
    entries = manifest.load_json(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    checked = cut(manifest.check(entries, hash_files(spark, folder)))
    return checked, manifest.check_summary(checked)


def inspect_mirror(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a mirror's folder holds: files and bytes by kind; one row of entries, skipped, failed, files_on_disk and bytes_on_disk; and the failures.

    Files on disk include the manifest's and the unrewritten bodies, as a walk over the folder finds them.
    """
    entries = cut(manifest.load_json(spark, f"{folder.rstrip('/')}/{MANIFEST}"))
    disk = list_files(spark, folder, hidden=True).agg(F.count(F.lit(1)).alias("files_on_disk"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_on_disk"))
    n = lambda state: F.count_if(F.col("state") == state).alias(state)
    counts = entries.agg(F.count(F.lit(1)).alias("entries"), n("skipped"), n("failed"))
    return manifest.by_kind(entries), counts.crossJoin(F.broadcast(disk)), manifest.failures(entries)  # one row
