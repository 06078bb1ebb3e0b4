"""Small sites from a start to written files: the cases of a whole mirror run."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from linkloom.operators import manifest, scope
from linkloom.operators.scope import Scope
from linkloom.plans import mirror as M
from linkloom.sources.files import ensure_folder, read_files, remove_folder, sorted_files, write_files
from linkloom.streaming.ingest import ingest, latest

HOME = "https://garden.example:8443"
COLUMNS = "url string, final_url string, status int, headers array<struct<name:string,value:string>>, body binary, truncated boolean, error string"
# A nursery's site: a base element, pages without a type, a deep hedge, an image in three sizes, a sheet that imports, a manifest.
GARDEN = {
    "/": ("text/html; charset=utf-8", '<html><head><base href="/shop/"><link rel="stylesheet" href="look/all.css?v=2"><link rel="manifest" href="/app.webmanifest"></head><body><img src="pot.webp" srcset="pot.webp 300w, pot-l.webp 900w"><div style="background:url(\'leaf.svg\')"></div><a href="roses">r</a><a href="/hedge/1">h</a><a href="/cellar/wine">w</a><a href="https://neighbour.example/x">n</a><a href="tel:12">t</a><a href="#seed">s</a></body></html>'),
    "/shop/roses": ("", '<title>Roses</title><a href="../big">big</a> <a href="thorn.pdf?x=1#p">pdf</a><iframe src="/frame.html"></iframe>'),
    "/shop/thorn.pdf?x=1": ("application/pdf", '%PDF <a href="/never">no</a>'),
    "/frame.html": ("text/html", '<a href="/shop/roses">back</a>'),
    "/big": ("text/html", '<a href="/only-from-big">x</a>'),
    "/only-from-big": ("text/html", "never reached"),
    "/hedge/1": ("text/html", '<a href="2">on</a>'), "/hedge/2": ("text/html", '<a href="3">on</a>'), "/hedge/3": ("text/html", "end of the hedge"),
    "/cellar/wine": ("text/html", "closed"),
    "/shop/look/all.css?v=2": ("text/css", "@import url(more.css); h1{background:url(../leaf.svg)}"), "/shop/look/more.css": ("text/css", "p{}"),
    "/shop/pot.webp": ("image/webp", "RIFF1"), "/shop/pot-l.webp": ("image/webp", "RIFF2"), "/shop/leaf.svg": ("", "<svg/>"),
    "/app.webmanifest": ("application/manifest+json", '{"name":"g"}'),
    "/robots.txt": ("text/plain", "User-agent: linkloom\nDisallow: /cellar\n"),
}


def table(spark, site, **changes):
    rows = []
    for path, (kind, body) in site.items():
        headers = [("Content-Type", kind), ("ETag", f'"{hashlib.md5(body.encode()).hexdigest()[:6]}"')]
        row = {"status": 200, "headers": headers, "body": body.encode(), "truncated": path == "/big", "error": ""} | changes.get(path, {})
        rows.append((HOME + path, HOME + path, row["status"], row["headers"], row["body"], row["truncated"], row["error"]))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def garden(spark):
    return table(spark, GARDEN)


@pytest.fixture(scope="module")
def whole(garden):
    return M.mirror(garden, f"{HOME}/", Scope(max_depth=4))


def done(m):
    return {r.path for r in m.manifest.collect() if r.state == "done"}


def rows_of(m):
    return {r.url.removeprefix(HOME): r for r in m.manifest.collect()}


FILES = {"index.html", "shop/roses.html", "shop/thorn@", "frame.html", "hedge/1.html", "hedge/2.html", "hedge/3.html", "shop/look/all@", "shop/look/more.css", "shop/pot.webp", "shop/pot-l.webp", "shop/leaf.svg", "app.webmanifest"}


def short(paths):
    return {p.split("@")[0] + "@" if "@" in p else p for p in paths}


def test_whole_site(whole):
    assert short(done(whole)) == FILES and whole.stop_reason == ""
    rows = rows_of(whole)
    assert {u: (r.state, r.note) for u, r in rows.items() if r.state != "done"} == {
        "/big": ("skipped", "exceeds --max-file-size"), "/cellar/wine": ("skipped", "disallowed by robots.txt"), "https://neighbour.example/x": ("skipped", "different origin"), "/never": ("failed", "not stored"),
    }
    # A page without a type and a document reached by navigation are pages; what a skipped page links to is not taken.
    assert rows["/shop/roses"].kind == rows["/shop/thorn.pdf?x=1"].kind == "html" and "/only-from-big" not in rows
    assert (rows["/hedge/3"].depth, rows["/frame.html"].depth, rows["/shop/leaf.svg"].depth) == (3, 2, 0)  # a frame is a page of its own
    content = {r.path: r.content for r in whole.pages.unionByName(whole.sheets).collect()}
    sheet = next(p for p in content if p.startswith("shop/look/all@"))
    home = content["index.html"]
    for part in ('<base href="./">', f'href="{sheet}"', 'src="shop/pot.webp"', 'srcset="shop/pot.webp 300w, shop/pot-l.webp 900w"', "shop/leaf.svg", 'href="shop/roses.html"', 'href="hedge/1.html"', f'href="{HOME}/cellar/wine"', 'href="https://neighbour.example/x"', 'href="tel:12"', 'href="#seed"', 'href="app.webmanifest"'):
        assert part in home, part
    assert f'href="{HOME}/big"' in content["shop/roses.html"] and '#p"' in content["shop/roses.html"] and 'src="../frame.html"' in content["shop/roses.html"]
    assert content[sheet] == GARDEN["/shop/look/all.css?v=2"][1]  # its neighbours lie beside it as they did
    counts = manifest.run_counters(whole.events).first()
    assert (counts.downloaded, counts.failed, counts.skipped, counts.pages, counts.assets) == (13, 1, 3, 7, 6)
    assert rows["/"].size == len(home.encode()) and rows["/"].sha256 == hashlib.sha256(home.encode()).hexdigest()


def test_limits(spark, garden):
    shallow = rows_of(M.mirror(garden, f"{HOME}/", Scope(max_depth=1, exclude=("**/hedge/**",), respect_robots=False)))
    assert shallow["/cellar/wine"].state == "done" and shallow["/hedge/1"].note == "matched --exclude **/hedge/**" and shallow["/shop/thorn.pdf?x=1"].note == "beyond --max-depth"
    few = M.mirror(garden, f"{HOME}/", Scope(recursive=False, max_files=3), rewrite_links=False)
    assert len(done(few)) == 3 and few.stop_reason == "reached --max-files (3)"
    assert [r.content for r in few.pages.collect()] == [GARDEN["/"][1]]
    assert spark.range(1).select(scope.stop_message(F.lit("max_total_size"), Scope(max_total_size=1 << 20))).first()[0] == "reached --max-total-size (1.0 MB)"
    listed = [r.url.removeprefix(HOME) for r in M.list_urls(garden, f"{HOME}/", Scope(recursive=False)).collect()]
    assert listed[0] == "/" and set(listed) == {"/", "/shop/look/all.css?v=2", "/shop/look/more.css", "/shop/pot.webp", "/shop/pot-l.webp", "/shop/leaf.svg", "/app.webmanifest"}


def test_write_resume_and_update(spark, garden, whole, tmp_path):
    folder = f"file://{tmp_path}/site"
    told = M.write_mirror(whole, folder)
    assert told.count() == 13 + 10  # files, and the bodies of pages, sheets and the manifest
    assert (tmp_path / "site/shop/pot.webp").read_bytes() == b"RIFF1"
    listed = [r.path for r in sorted_files(read_files(spark, folder)).collect()]
    assert short(listed) == FILES and listed == sorted(listed)
    found = read_files(spark, folder, content=True).select("path", F.sha2("body", 256).alias("sha256"))
    assert manifest.check_summary(manifest.check(whole.manifest, found)).first().ok

    # Nothing is taken again while the files are there; links go on from the bodies that were kept.
    stored = M.read_mirror(spark, folder)
    again = M.mirror(garden, f"{HOME}/", Scope(max_depth=4), stored=stored)
    counts = manifest.run_counters(again.events).first()
    assert (counts.downloaded, counts.reused, counts.bytes) == (0, 13, 0) and short(done(again)) == FILES
    assert {r.path: r.content for r in again.pages.collect()} == {r.path: r.content for r in whole.pages.collect()}
    assert again.binaries.count() == again.raw.count() == 0
    (tmp_path / "site/shop/pot.webp").unlink()
    how = {r.url.removeprefix(HOME): r.outcome for r in M.resources(garden, Scope(), M.read_mirror(spark, folder)).collect()}
    assert how["/shop/pot.webp"] == "downloaded" and how["/shop/pot-l.webp"] == how["/"] == "reused" and how["/big"] == "skipped"

    # An update: all unchanged but one page, which now links to a new one.
    site = {k: v for k, v in GARDEN.items() if k != "/robots.txt"} | {"/hedge/3": ("text/html", '<a href="/new">new</a>'), "/new": ("text/html", "new")}
    same = {"status": 304, "body": b"", "headers": []}
    changed = table(spark, site, **{k: same for k in site if k not in ("/hedge/3", "/new", "/big")})
    m = M.mirror(changed, f"{HOME}/", Scope(max_depth=5, respect_robots=False, exclude=("**/cellar/**",)), stored=M.read_mirror(spark, folder), update=True)
    counts = manifest.run_counters(m.events).first()
    assert (counts.downloaded, counts.unchanged) == (2, 12)
    rows = rows_of(m)
    assert rows["/new"].path == "new.html" and rows["/"].etag == rows_of(whole)["/"].etag and {r.path: r.content for r in m.pages.collect()}["hedge/3.html"] == '<a href="../new.html">new</a>'


def test_files(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    rows = spark.createDataFrame([("x/y.bin", b"1"), ("x/y.bin", b"1"), ("z", None)], "path string, body binary")
    assert {(r.path, r.size) for r in write_files(rows, folder).collect()} == {("x/y.bin", 1), ("z", 0)}
    with pytest.raises(Exception, match="leads out"):
        write_files(spark.createDataFrame([("../q", b"1")], "path string, body binary"), folder)
    assert not (tmp_path / "q").exists() and not list(tmp_path.glob("a/**/_*.tmp"))
    assert ensure_folder(spark, f"{folder}/new") and remove_folder(spark, folder) and not remove_folder(spark, folder)
    assert read_files(spark, folder).count() == 0


def test_budget_over_ranges(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 13, i % 5 != 0) for i in range(500)], "i long, size long, file boolean").repartition(9)
    s = Scope(max_files=60, max_total_size=10_000)
    got = {r.i: r.stop for r in scope.within_budget(rows, "size", ["i"], s, counts=F.col("file")).collect()}
    n = 0
    for i in range(500):
        assert got[i] == ("max_files" if n >= 60 else None)
        n += i % 5 != 0


def test_robots_join_ways_agree(spark):
    rows = spark.createDataFrame([(f"o{i % 3}", f"/p/{i}") for i in range(60)], "origin string, path string")
    rules = spark.createDataFrame([("o0", "/p/1", False), ("o0", "/p/12", True), ("o1", "/", False)], "origin string, pattern string, allow boolean")
    few, many = (sorted(map(tuple, scope.robots_allowed(rows, rules, broadcast_rules=k).collect())) for k in (100, 0))
    assert few == many and len(few) == 60 and {r[2] for r in few if r[0] == "o1"} == {False}


def test_configuration():
    s = scope.from_config('﻿{"max_depth": 2, "max_files": "many", "recursive": false, "same_origin": 0, "include": ["**"], "what": 1}')
    assert (s.max_depth, s.max_files, s.recursive, s.same_origin, s.include) == (2, 5000, False, True, ("**",))
    for text in ("{", "[1]"):
        with pytest.raises(ValueError):
            scope.from_config(text)


def test_reports_tell_the_remainder(spark):
    m = manifest.lenient(spark.createDataFrame([(f"u{i}", "failed") for i in range(20)], "url string, state string"))
    assert [(r.url, r.more) for r in manifest.top_failures(m, 3).collect()] == [("u0", 17), ("u1", 17), ("u10", 17)]
    checked = spark.createDataFrame([(f"u{i}", f"p{i}", v) for i in range(9) for v in ("missing", "verified")] + [("c", "c", "corrupted")], "url string, path string, verdict string")
    assert {(r.verdict, r.more) for r in manifest.top_problems(checked, 2).collect()} == {("missing", 7), ("corrupted", 0)}


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("u1", 1, 1), ("u2", 2, 1)], "url string, size long, fetched_at long")
    source, folder = str(tmp_path / "in"), str(tmp_path / "m")
    for k, batch in enumerate((rows, spark.createDataFrame([("u1", 9, 2)], rows.schema), spark.createDataFrame([("u3", 3, 1)], rows.schema))):
        batch.coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(rows.schema).parquet(source), folder, str(tmp_path / ("c" if k < 2 else "other"))).awaitTermination()
        if k == 1:
            assert {(r.url, r.size) for r in latest(spark, folder).collect()} == {("u1", 9), ("u2", 2)}
    # A stream with another checkpoint adds to the same folder.
    assert {(r.url, r.size) for r in latest(spark, folder).collect()} == {("u1", 9), ("u2", 2), ("u3", 3)}
    assert json.loads(manifest.to_json(latest(spark, folder)).where("url = 'u1'").first().entry)["size"] == 9
