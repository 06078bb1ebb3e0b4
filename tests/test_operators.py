"""Scanners, link discovery, scope, manifest, frontier and rewriting on small sites."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.operators import frontier, links, manifest, rewrite, scan, scope
from linkloom.sources import responses

PAGE = b"""<!DOCTYPE html><!-- <a href=x> --><html><head><title><a href="no"></title><BASE HREF='/b/'>
<link rel="stylesheet" href="s.css"><link rel=icon href=i.png><link href="plain"><meta http-equiv=Refresh content="5; URL='next'">
<meta property="og:image" content="o.png"><style>@import "x.css"; a{background:url( 'y.png' )} /* url(z) */</style></head>
<body background=bg.png><a href="p?a=1&amp;b=2" href=dup>t</a><a>no</a><img src=i1.png srcset="s1.png 1x, s2.png 2x"><div style="background:url(&quot;q.png&quot;)">
<script src="j.js">var a="<a href='no'>"</script><iframe src=f.html></iframe><a href="">e</a><a href="u\xc3\xa9">z</a></body>"""


def test_scan_html():
    found, base, head_end = scan.html_links(PAGE)
    assert base == "/b/" and PAGE[head_end:].startswith(b"</head>")
    assert [(x[2], x[3], x[6]) for x in found if x[3] not in ("style_block", "inline_style")] == [
        ("/b/", "base", "other"), ("s.css", "asset", "css"), ("i.png", "asset", "image"), ("plain", "navigation", "other"), ("next", "meta_refresh", "html"),
        ("o.png", "asset", "image"), ("bg.png", "asset", "image"), ("p?a=1&b=2", "navigation", "html"), ("i1.png", "asset", "image"), ("s1.png 1x, s2.png 2x", "srcset", "image"),
        ("j.js", "asset", "js"), ("f.html", "navigation", "html"), ("ué", "navigation", "html"),
    ]
    for offset, length, value, *_ in found:
        assert scan.decode_entities_text(PAGE[offset : offset + length].decode()) == value or value.startswith("@import")


def test_scan_html_survives_broken_markup():
    for html in (b"<", b"<a", b"<a href", b"<a href=", b'<a href="x', b"<!--", b"<!x", b"</a", b"<style>a", b"<a / / href=x/>", b"<a =b href=c>", b"< a href=x>"):
        scan.html_links(html)
    assert [x[2] for x in scan.html_links(b"<script><a href=x></a>")[0]] == ["x"]  # never closed: markup again
    assert [x[2] for x in scan.html_links(b"<a =b href=c>")[0]] == ["c"]


def test_scan_css():
    css = rb"""@import "a.css"; @import url(b.css); .x{background:url("c\"d.png")} /* url(no) */ .y::after{content:"url(no)"} .myurl(no){} .z{src:url( e.woff )} url()"""
    got = [(css[o : o + n], v, i) for o, n, v, i in scan.css_links(css)]
    assert [(v, i) for _, v, i in got] == [("a.css", True), ("b.css", False), ('c"d.png', False), ("e.woff", False)]


def test_robots():
    text = "User-agent: *\nDisallow: /private/\n\nUser-agent: Loom\nUser-agent: other\nAllow: /private/ok # c\nDisallow:\nCrawl-delay: 1.5\nSitemap: http://x/s.xml\n"
    assert scan.robots(text, "nobody") == ([("/private/", False)], ["http://x/s.xml"], 0)
    assert scan.robots(text, "loombot") == ([("/private/ok", True)], ["http://x/s.xml"], 1500)
    assert scan.robots("", "x") == ([], [], 0)


def test_discover(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a/", PAGE.decode()), (2, "http://h.com/", None)], "page_id long, url string, html string")
    got = {(r.key, r.role, r.hint) for r in links.discover_html(pages).select(U.url_key(F.col("target")).alias("key"), "role", "hint").collect()}
    b = "http://h.com/b/"
    assert got == {
        (b + "s.css", "asset", "css"), (b + "i.png", "asset", "image"), (b + "plain", "navigation", "other"), (b + "next", "navigation", "html"), (b + "o.png", "asset", "image"),
        (b + "x.css", "asset", "css"), (b + "y.png", "asset", "other"), (b + "bg.png", "asset", "image"), (b + "p?a=1&b=2", "navigation", "html"), (b + "i1.png", "asset", "image"),
        (b + "s1.png", "asset", "image"), (b + "s2.png", "asset", "image"), (b + "q.png", "asset", "other"), (b + "j.js", "asset", "js"), (b + "f.html", "navigation", "html"), (b + "ué", "navigation", "html"),
    }
    css = spark.createDataFrame([(1, "http://h.com/s/x.css", '@import "a.css"; b{c:url(../d.png)} e{f:url(data:,x)}')], "id int, url string, css string")
    assert [tuple(r) for r in links.discover_css(css).select(U.url_key(F.col("target")), "hint").collect()] == [("http://h.com/s/a.css", "css"), ("http://h.com/d.png", "other")]


def test_scope(spark):
    s = scope.Scope(primary="https://h.com/", max_depth=2, exclude=("**/tmp/**",), include=("https://**",), external_assets=False)
    rows = [
        ("https://h.com/a", "navigation", 1, None), ("mailto:x", "navigation", 0, "unsupported scheme"), ("https://10.0.0.1/", "asset", 0, "private or loopback host"),
        ("https://h.com/tmp/x", "asset", 0, "matched --exclude **/tmp/**"), ("http://h.com/", "navigation", 0, "did not match any --include pattern"),
        ("https://h.com/a", "navigation", 3, "beyond --max-depth"), ("https://o.com/", "navigation", 1, "different origin"), ("https://o.com/x.png", "asset", 9, "third-party asset"),
    ]
    df = spark.createDataFrame(rows, "u string, role string, depth int, want string")
    for r in df.withColumn("got", scope.scope_reason(U.parse(F.col("u")), F.col("role"), F.col("depth"), s)).collect():
        assert r.got == r.want, r


def test_robots_allowed(spark):
    rules = spark.createDataFrame([("o", "/", False), ("o", "/open", True), ("o", "/open/*x$", False), ("o", "/open/*x$", True)], "origin string, pattern string, allow boolean")
    rows = spark.createDataFrame([("o", "/"), ("o", "/open/a"), ("o", "/open/ax"), ("p", "/"), ("o", "")], "origin string, path string")
    assert [r.allowed for r in scope.robots_allowed(rows, rules).orderBy("origin", "path").collect()] == [False, False, True, True, True]


def test_budget(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(5)], "i int, size long")
    got = lambda **k: [r.stop for r in scope.within_budget(rows, "size", ["i"], scope.Scope(**k)).orderBy("i").collect()]
    assert got(max_files=2) == [None, None, "max_files", "max_files", "max_files"]
    assert got(max_total_size=25) == [None, None, None, "max_total_size", "max_total_size"]


def entries(spark, rows):
    return manifest.lenient(spark.createDataFrame(rows, "url string, path string, sha256 string, size long, kind string, state string, status int, note string, fetched_at long, etag string"))


@pytest.fixture(scope="module")
def table(spark):
    return entries(spark, [("u1", "a.html", "h1", 10, "html", "done", 200, "", 1, "e1"), ("u2", "b.css", "", 5, "css", "done", 200, "", 1, ""), ("u3", "", "", 0, "odd", "failed", 404, "not found", 1, ""), ("u4", "c.png", "h4", 7, "image", "odd", 200, None, 1, "e4")])


def test_manifest_reports(spark, table):
    assert {(r.kind, r.files, r.bytes) for r in manifest.by_kind(table).collect()} == {("html", 1, 10), ("css", 1, 5), ("image", 1, 7)}
    assert [tuple(r) for r in manifest.failures(table).collect()] == [("u3", 404, "not found")]
    assert tuple(manifest.count_states(table).first()) == (3, 1, 0)
    assert manifest.total_bytes(table).first()[0] == 22
    files = spark.createDataFrame([("a.html", "h1"), ("b.css", "x")], "path string, sha256 string")
    assert {(r.url, r.verdict) for r in manifest.check(table, files).collect()} == {("u1", "verified"), ("u2", "unverifiable"), ("u4", "missing")}
    assert tuple(manifest.check_summary(manifest.check(table, files)).first()) == (1, 1, 0, 1, False)
    reuse, fetch = manifest.split_resume(table.select("url"), table, files)
    assert ({r.url for r in reuse.collect()}, {r.url for r in fetch.collect()}) == ({"u1", "u2"}, {"u3", "u4"})


def test_manifest_upkeep(spark, table, tmp_path):
    change = entries(spark, [("u1", "a.html", "h9", 11, "html", "done", 200, "", 2, "e2"), ("u9", "z", "", 1, "html", "done", 200, "", 2, "")])
    new = manifest.upsert(table, change)
    assert new.count() == 5 and new.where("url = 'u1'").first().sha256 == "h9"
    assert {(r.url, r.change) for r in manifest.diff(table, new).collect()} == {("u1", "changed"), ("u2", "unchanged"), ("u3", "unchanged"), ("u4", "unchanged"), ("u9", "added")}
    assert manifest.remove(new, change).count() == 3
    manifest.save_json(new, str(tmp_path / "m"))
    back = manifest.load_json(spark, str(tmp_path / "m"))
    assert sorted(back.collect()) == sorted(new.select(back.columns).collect())


def test_manifest_document(spark, table, tmp_path):
    file = tmp_path / "manifest.json"
    assert manifest.load_document(spark, str(file))[1].count() == 0
    file.write_text(manifest.document_text(table, "http://h/", 5).first()[0])
    head, back = manifest.load_document(spark, str(file))
    assert (head["format"], head["source"], head["created_at"]) == (1, "http://h/", 5)
    assert sorted(back.collect()) == sorted(table.select(back.columns).collect()) and '"note" : ""' not in file.read_text()
    for text, words in (("{", "JSON"), ('{"format": 2}', "newer")):
        file.write_text(text)
        with pytest.raises(ValueError, match=words):
            manifest.load_document(spark, str(file))


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b", "navigation", 0), ("b", "c", "navigation", 0), ("c", "a", "navigation", 0), ("a", "s", "asset", 1), ("s", "t", "asset", 0), ("c", "d", "navigation", 1), ("b", "s", "asset", 1)], "src string, dst string, role string, pos int")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in frontier.expand(seeds, edges, 2).where("reason is null").collect()} == {("a", 0), ("s", 0), ("t", 0), ("b", 1), ("c", 2)}
    assert {(r.url, r.depth, r.reason) for r in frontier.expand(seeds, edges, 2).where("reason is not null").collect()} == {("d", 3, "beyond --max-depth")}
    assert frontier.expand(seeds, edges, 9).count() == 6


def test_rewrite(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a/", "a/index.html", PAGE.decode())], "page_id long, url string, document_path string, html string")
    table = entries(spark, [("http://h.com/b/s.css", "b/s.css", "", 1, "css", "done", 200, "", 1, ""), ("http://h.com/b/y.png", "b/y.png", "", 1, "image", "done", 200, "", 1, ""), ("http://h.com/b/s2.png", "b/s2 x.png", "", 1, "image", "done", 200, "", 1, "")])
    r = rewrite.rewrite_html(pages, table).first()
    for part in ('HREF=\'./\'', 'href="../b/s.css"', "url( '../b/y.png' )", '@import "http://h.com/b/x.css"', "srcset=\"http://h.com/b/s1.png 1x, ../b/s2%20x.png 2x\"", 'href="http://h.com/b/p?a=1&amp;b=2"', "url(&quot;http://h.com/b/q.png&quot;)", "url(z)"):
        assert part in r.content, part
    assert (r.localised, r.absolutised, r.untouched) == (4, 13, 0)
    css = spark.createDataFrame([(1, "http://h.com/b/s.css", "b/s.css", "a{b:url(y.png)} c{d:url(data:,x)} e{f:url('z.png')}")], "sheet_id int, url string, document_path string, css string")
    c = rewrite.rewrite_css(css, table).first()
    assert c.content == "a{b:url(y.png)} c{d:url(data:,x)} e{f:url('http://h.com/b/z.png')}" and (c.localised, c.absolutised, c.untouched) == (1, 1, 1)
    assert rewrite.splice(b"abcdef", [(4, 1, b"X"), (1, 2, b""), (2, 1, b"no")]) == b"adXf"


def test_headers_and_files(spark, values, tmp_path):
    block = "HTTP/1.1 301 Moved\r\nLocation: /x\r\nETag: \"a\"\r\n\r\nHTTP/1.1 200 OK\r\netag:  \"b\" \r\nbad line\r\n"
    h = responses.parse_headers(F.col("a"))
    assert values([block], responses.find_header(h, "ETAG"), responses.find_header(h, "nope"), F.size(h)) == [('"a"', "", 3)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("abc")
    (tmp_path / "y.bin").write_bytes(b"12345")
    files = responses.files_in(spark, str(tmp_path))
    assert {(r.path, r.size) for r in files.collect()} == {("d/x.txt", 3), ("y.bin", 5)} and tuple(responses.folder_stats(files).first()) == (2, 8)


def test_links_of_a_constant_url(spark):
    rows = spark.createDataFrame([(1, '<base href="/b/"><a href="x">y</a>'), (2, "<p>")], "id long, html string").withColumn("url", F.lit("http://a.b/c"))
    assert [(r.id, r.target.path) for r in links.discover_html(rows).collect()] == [(1, "/b/x")]
