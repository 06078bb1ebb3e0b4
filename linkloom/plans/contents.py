"""Registered queries that read functions' inputs out of the pages themselves, and runs that write and read folders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import classify as K
from linkloom.functions import codec
from linkloom.functions import json as J
from linkloom.functions import paths as P
from linkloom.functions import tables
from linkloom.functions import text as X
from linkloom.functions import url as U
from linkloom.operators import manifest as M
from linkloom.operators import scope as C
from linkloom.plans import mirror as W
from linkloom.plans.queries import _DEPTHS, _FAN, _HOST, _HREFS, _I, _KEY, _MANIFEST, _SITE, derived, pages, query, site
from linkloom.plans.upkeep import _folder
from linkloom.session import cut
from linkloom.sources.files import read_files


@query("""SELECT page_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0::DOUBLE) ELSE ms // 60000 || 'm ' || ms // 1000 % 60 || 's' END AS text
    FROM (SELECT page_id, (page_id * page_id * 37 + strlen(html) * (page_id % 9)) % 150000 AS ms FROM pages)""")
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("page_id") * F.col("page_id") * 37 + F.octet_length("html") * (F.col("page_id") % 9)) % 150000
    return pages(spark, sf_dir).select("page_id", X.human_duration_ms(ms.cast("long")).alias("text"))


@query("""SELECT page_id, printf('%08x', list_reduce(list_prepend(1939669891, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 435) & 4294967295)) AS hash FROM pages""")
def url_short_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.short_hash(F.col("url")).alias("hash"))


@query("""WITH v AS (SELECT page_id, [page_id % 3, page_id % 12, page_id % 5] AS a, [page_id * 7 % 3, page_id * 5 % 12, strlen(html) % 5] AS b FROM pages) SELECT page_id, b > a AS newer, a = b AS same FROM v""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions out of page numbers and sizes, with marks that do not count."""
    dotted = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    i = F.col("page_id")
    a = F.concat(F.when(i % 2 == 0, "v").otherwise(" V"), dotted(i % 3, i % 12, i % 5), F.when(i % 7 == 0, "-rc.9").otherwise(""))
    b = F.concat(dotted(i * 7 % 3, i * 5 % 12, F.octet_length("html") % 5), F.when(i % 4 == 0, "+build.3").otherwise(""))
    return pages(spark, sf_dir).select("page_id", X.semver(a).alias("a"), X.semver(b).alias("b")).select("page_id", (F.col("b") > F.col("a")).alias("newer"), (F.col("a") == F.col("b")).alias("same"))


@query("SELECT page_id, sha256(html) AS sha256, '&' || page_id || chr((65 + page_id % 26)::INT) || '<\"&nope; &' AS forms FROM pages")
def entities_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, encoded and decoded again; and named, decimal, hexadecimal and unknown references."""
    i = F.col("page_id")
    letter = 65 + i % 26
    text = F.concat(F.lit("&AMP;"), i.cast("string"), F.when(i % 2 == 0, F.concat(F.lit("&#"), letter.cast("string"))).otherwise(F.concat(F.lit("&#x"), F.hex(letter))), F.lit(";&lt;&quot;&nope; &"))
    back = codec.decode_entities(codec.encode_attribute(F.col("html")))
    return pages(spark, sf_dir).select("page_id", F.sha2(F.encode(back, "UTF-8"), 256).alias("sha256"), codec.decode_entities(text).alias("forms"))


@query("""SELECT page_id, sha256(replace(replace(html, '\\', '\\\\'), '"', '\\"')) AS escaped, sha256(html) AS back FROM pages""")
def css_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    escaped = codec.escape_css(F.col("html"))
    return pages(spark, sf_dir).select("page_id", hashed(escaped).alias("escaped"), hashed(codec.unescape_css(escaped)).alias("back"))


# What resources are by their names and types, and whether their statuses are tried again.
_NAMED = [("HTM", "html"), (".css", "css"), ("mjs", "js"), ("PNG", "image"), (".woff2", "font"), ("flac", "media"), ("webmanifest", "manifest"), ("zip", "other"), ("", "other"), ("tar.gz", "other")]
_TYPED = [("TEXT/html; charset=x", "html"), ("text/css", "css"), ("application/ecmascript", "js"), ("image/anything", "image"), ("font/x", "font"), ("video/y", "media"), ("application/manifest+json", "manifest"), ("text/plain", "other"), ("", "other")]
_TRIED = [(200, False), (304, False), (404, False), (408, True), (425, True), (429, True), (500, True), (501, False), (502, True), (503, True), (504, True)]
_list = lambda rows, k: "[" + ", ".join(f"'{r[k]}'" if isinstance(r[k], str) else str(r[k]).upper() for r in rows) + "]"


def _pick(rows: list[tuple], i):
    return F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (i % len(rows) + 1).cast("int"))


@query(f"""SELECT page_id, {_list(_NAMED, 1)}[page_id % {len(_NAMED)} + 1] AS by_name, {_list(_TYPED, 1)}[page_id % {len(_TYPED)} + 1] AS by_type, {_list(_TRIED, 1)}[page_id % {len(_TRIED)} + 1] AS retryable,
    least(8000, 250 * 2 ** (page_id % 9)::INT)::BIGINT AS wait FROM pages""")
def resource_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return pages(spark, sf_dir).select(
        "page_id", K.kind_from_extension(_pick(_NAMED, i)).alias("by_name"), K.kind_from_content_type(_pick(_TYPED, i)).alias("by_type"), K.is_retryable(_pick(_TRIED, i)).alias("retryable"),
        K.backoff_ms((1 + i % 9).cast("int")).alias("wait"),
    )


@query(f"""SELECT page_id, replace(html, 'the', '<>') = html AS untouched, sha256(replace(html, 'the', '<>')) AS sha256, {_HOST} || '_' || (81 + page_id % 9) AS folder,
    [TRUE, TRUE, FALSE, FALSE, FALSE][page_id % 5 + 1] AS looks_like_url FROM pages""")
def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal replacement over whole pages, output folders of their sites on other ports, and what looks like a URL."""
    i = F.col("page_id")
    parts = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    ported = F.concat(parts[0], F.lit(":"), (81 + i % 9).cast("string"), parts[1])
    text = F.when(i % 5 == 0, F.upper("url")).when(i % 5 == 1, F.concat(U.parse(F.col("url"))["host"], F.lit("/x"))).when(i % 5 == 2, F.concat(F.lit("./"), "url")).when(i % 5 == 3, F.concat(F.lit("a.b c"), "url")).otherwise("plain")
    done = X.replace_all(F.col("html"), F.lit("the"), F.lit("<>"))
    return pages(spark, sf_dir).select("page_id", (done == F.col("html")).alias("untouched"), F.sha2(F.encode(done, "UTF-8"), 256).alias("sha256"), P.default_output_directory(U.parse(ported)).alias("folder"), U.looks_like_url(text).alias("looks_like_url"))


@query(f"""SELECT page_id, page_id % 4 != 3 AS valid, CASE WHEN page_id % 4 = 3 THEN '-' ELSE 'last ' || {_I} END AS text, CASE WHEN page_id % 4 = 3 THEN -1.0 ELSE page_id + 0.5 END AS number, page_id % 4 != 3 AND page_id % 2 = 0 AS flag,
    CASE WHEN page_id % 4 = 3 THEN '' ELSE chr(128512) || url END AS deep, '-' AS other, page_id % 4 != 3 AS has_text FROM pages""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of every page: keys that repeat, surrogates, a byte order mark; each fourth has something after its end."""
    i, text = F.col("page_id"), F.col("page_id").cast("string")
    body = F.concat(
        F.when(i % 3 == 0, "﻿").otherwise(""), F.lit('{"t": "first", "n": '), text, F.lit('.5, "f": '), F.when(i % 2 == 0, "true").otherwise("false"),
        F.lit(', "o": {"t": "inner", "d": "\\uD83D\\uDE00'), "url", F.lit('"}, "x": {"t": 1}, "t": "last '), text, F.lit('"}'), F.when(i % 4 == 3, " 1").otherwise(" \n"),
    )
    rows = pages(spark, sf_dir).select("page_id", J.parse(body).alias("j"))
    j = F.col("j")
    return rows.select(
        "page_id", j.isNotNull().alias("valid"), J.text_at(j, "t", otherwise="-").alias("text"), J.number_at(j, "n", otherwise=-1.0).alias("number"), J.flag_at(j, "f").alias("flag"),
        J.text_at(j, "o", "d").alias("deep"), J.text_at(j, "x", "t", otherwise="-").alias("other"), J.contains(j, "t").alias("has_text"),
    )


# Runs over the site of all pages.


@query(f"""WITH {_DEPTHS}, u AS (SELECT '{_SITE}/p/' || page_id AS url FROM d UNION SELECT '{_SITE}/i/' || page_id % 7 || '.png' FROM d UNION SELECT '{_SITE}/i/' || x || '.png' FROM (VALUES ('a'), ('b')) AS v(x)
    UNION SELECT '{_SITE}/' || x FROM (VALUES ('s.css'), ('t.css')) AS v(x) UNION SELECT url FROM a WHERE NOT starts_with(url, '{_SITE}/the')) SELECT url FROM u""")
def mirror_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would take, without taking it."""
    return W.list_urls(site(spark, sf_dir), f"{_SITE}/p/0", C.Scope(max_depth=40))


@query(f"""SELECT x AS start, 0 AS depth, 'skipped' AS state, note FROM (VALUES ('{_SITE}/the/first', 'disallowed by robots.txt'), ('{_SITE}/p/1', 'matched --exclude **/p/1')) AS v(x, note)
    UNION ALL SELECT '{_SITE}/p/2', NULL, 'done', count(*)::VARCHAR FROM (SELECT max(page_id) AS last FROM pages), (SELECT unnest(generate_series({_FAN * 2 + 1}, {_FAN * 3})) AS x) WHERE x <= last""")
def mirror_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that robots.txt and scope refuse, and one that is taken, with how many pages it leads to in one step."""
    given = cut(site(spark, sf_dir))
    s = C.Scope(max_depth=1, exclude=("**/p/1",), max_files=1 << 40, max_total_size=1 << 60, download_assets=False)
    taken = W.resources(given, s)
    reached = [W.reach(taken, given, at, replace(s, primary=at), "linkloom") for at in (f"{_SITE}/the/first", f"{_SITE}/p/1")]
    told = [r.select(F.col("url").alias("start"), "depth", F.when(F.col("reason").isNull(), "done").otherwise("skipped").alias("state"), F.col("reason").alias("note")) for r in reached]
    listed = W.list_urls(given, f"{_SITE}/p/2", s).where(f"url like '{_SITE}/p/%' and url != '{_SITE}/p/2'")
    n = listed.agg(F.count(F.lit(1)).cast("string").alias("note"))
    return told[0].unionByName(told[1]).unionByName(n.select(F.lit(f"{_SITE}/p/2").alias("start"), F.lit(None).cast("int").alias("depth"), F.lit("done").alias("state"), "note"))


@query("SELECT 'reached --max-files (' || (count(*) // 2 + 3) || ')' AS stop_reason, (count(*) // 2 + 3)::BIGINT AS files FROM pages")
def mirror_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that half as many files as there are pages stop."""
    n = pages(spark, sf_dir).count() // 2 + 3
    m = W.mirror(site(spark, sf_dir), f"{_SITE}/p/0", C.Scope(max_depth=40, max_files=n, max_total_size=1 << 60))
    return m.manifest.agg(F.lit(m.stop_reason).alias("stop_reason"), F.count_if(F.col("state") == "done").alias("files"))


_PLAIN = f"""n AS (SELECT max(page_id) AS last FROM pages), w AS (SELECT page_id, '<img src="/i/' || page_id % 7 || '.png" srcset="/i/a.png 1x, /i/b.png 2x"><link rel="stylesheet" href="/s.css">'
    || coalesce(array_to_string([CASE WHEN x <= last THEN '<a href="/p/' || x || '">c</a>' END for x in generate_series({_FAN} * page_id + 1, {_FAN} * page_id + {_FAN})], ''), '') || html AS content FROM pages, n)"""


@query(f"""WITH {_PLAIN} SELECT 'p/' || page_id || '.html' AS path, sha256(content) AS sha256, 0::BIGINT AS localised FROM w
    UNION ALL SELECT 's.css', sha256('@import "t.css"; b{{c:url(/i/0.png)}}'), 0 UNION ALL SELECT 't.css', sha256('d{{}}'), 0""")
def mirror_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and sheets of a run that rewrites no links."""
    m = W.mirror(site(spark, sf_dir), f"{_SITE}/p/0", C.Scope(max_depth=40, max_files=1 << 40, max_total_size=1 << 60), rewrite_links=False)
    return m.pages.unionByName(m.sheets).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), "localised")


@query(f"""WITH {_PLAIN} SELECT 'p/' || page_id || '.html' AS path, sha256(content) AS sha256, strlen(content)::BIGINT AS size FROM w UNION ALL SELECT 's.css', sha256(x), strlen(x) FROM (VALUES ('@import "t.css"; b{{c:url(/i/0.png)}}')) AS v(x)
    UNION ALL SELECT 't.css', sha256('d{{}}'), 3 UNION ALL SELECT 'i/' || k || '.png', sha256('png' || k), 4 FROM (SELECT DISTINCT page_id % 7 AS k FROM pages)""")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a run, as they are in its folder afterwards."""
    m = W.mirror(site(spark, sf_dir), f"{_SITE}/p/0", C.Scope(max_depth=40, max_files=1 << 40, max_total_size=1 << 60), rewrite_links=False)
    folder = _folder(spark, "mirror")
    W.write_mirror(m, folder)
    return read_files(spark, folder, content=True).select("path", F.sha2("body", 256).alias("sha256"), "size")


# Table functions in SQL, and the manifest as one document.


@query(f"""SELECT page_id, 'navigation' AS role, 'html' AS hint, href AS value, NULL::VARCHAR AS base FROM (SELECT page_id, {_HREFS} AS href FROM pages)
    UNION ALL SELECT page_id, 'asset', 'image', 'i' || page_id || '.png', '/b' || page_id FROM pages UNION ALL SELECT page_id, 'style_block', 'css', 'i.css', '/b' || page_id FROM pages
    UNION ALL SELECT page_id, 'base', 'other', '/b' || page_id, '/b' || page_id FROM pages""")
def references_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of all pages, and of small ones made for each, by LATERAL."""
    tables.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("_pages_of_references")
    made = """SELECT page_id, html FROM _pages_of_references UNION ALL
        SELECT page_id, concat('<base href="/b', page_id, '"><img src="i', page_id, '.png"><style>@import "i.css";</style>') FROM _pages_of_references"""
    return spark.sql(f"SELECT p.page_id, r.role, r.hint, r.value, r.base FROM ({made}) AS p, LATERAL page_references(p.html) AS r")


@query("""SELECT page_id, '/p' || page_id AS pattern, FALSE AS allow FROM pages UNION ALL SELECT page_id, '/p' || page_id || '/ok', TRUE FROM pages WHERE page_id % 3 = 0""")
def rules_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("_pages_of_rules")
    text = r"concat('User-agent: loom\nDisallow: /p', page_id, '\n', if(page_id % 3 = 0, concat('Allow: /p', page_id, '/ok\n'), ''), 'User-agent: *\nDisallow: /\n')"
    return spark.sql(f"SELECT p.page_id, r.pattern, r.allow FROM (SELECT page_id, {text} AS text FROM _pages_of_rules) AS p, LATERAL robots_rules(p.text, 'loombot') AS r")


@query(f"WITH {_MANIFEST}, b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1) SELECT url, path, etag, sha256, size, kind, state, status, note FROM b")
def manifest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, written by all tasks as one JSON document and read back."""
    base = cut(derived(spark, sf_dir))
    newest = base.groupBy("url").agg(F.max("page_id").alias("page_id"))
    file = f"{_folder(spark, 'manifest')}/manifest.json"
    M.save_document(base.join(newest, ["url", "page_id"]), file, "http://site.test/", 1, 2)
    return M.load_document(spark, file)[1].select("url", "path", "etag", "sha256", "size", "kind", "state", "status", "note")
