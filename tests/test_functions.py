"""Known answers of the scalar functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import classify, codec, paths, patterns
from linkloom.functions import json as J
from linkloom.functions import text as X
from linkloom.functions import url as U


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global A, B, C
    A, B, C = F.col("a"), F.col("b"), F.col("c")


def test_url_parse(values):
    u = U.parse(A)
    rows = ["http://Example.COM:80/a/./b/../c//d?x=1#f", "https://u:p@h.com:8443", "mailto:a@b", "http://", "http://h:99999/", "http://[::1]:8080/x", "//x/y", "http://h:/?", " http://h\t/a b ", "http://h:8x/"]
    assert values(rows, U.url_key(u)) == [
        "http://example.com/a/c/d?x=1", "https://u:p@h.com:8443/", "mailto:a@b", None, None, "http://[::1]:8080/x", None, "http://h/", "http://h/a b", "http://h:8x/",
    ]
    assert values(rows[:2], u["fragment"], U.effective_port(u), U.origin(u)) == [("f", 80, "http://example.com"), (None, 8443, "https://h.com:8443")]


def test_dot_segments(values):
    got = values(["/a/b/../c", "/a/./b", "/../x", "/a/..", "a//b/", "", "..", "/a/b/."], U.remove_dot_segments(A))
    assert got == ["/a/c", "/a/b", "/x", "/", "a/b/", "", "/", "/a/b/"]


def test_resolve(values):
    base = "http://example.com/a/b/c?q=1"
    refs = {
        "../x": "http://example.com/a/x", "?y=2": "http://example.com/a/b/c?y=2", "": base, "#z": base + "#z", "/r": "http://example.com/r",
        "//o.com": "http://o.com/", "g/./h/..": "http://example.com/a/b/g/", "d?e#f": "http://example.com/a/b/d?e#f", "a:b": "a:b", "https://x/": "https://x/",
    }
    assert values([(base, r) for r in refs], U.to_text(U.resolve(U.parse(A), B))) == list(refs.values())


def test_hosts(values):
    private = ["localhost", "a.local", "10.0.0.1", "172.16.3.4", "100.64.1.1", "224.0.0.1", "::1", "::ffff:127.0.0.1", "fd00::1", "fe80::2", "intranet", ""]
    public = ["8.8.8.8", "172.32.0.1", "256.1.1.1", "a.b.com", "2001:db8::1", "::ffff:8.8.8.8"]
    assert values(private + public, U.is_private_host(A)) == [True] * len(private) + [False] * len(public)
    pairs = [("example.com", "www.example.com"), ("example.com", "badexample.com"), ("a.com", "a.com"), ("", "a.com")]
    assert values(pairs, U.same_site(A, B)) == [True, False, True, False]


def test_references_and_targets(values):
    assert values(["", "#a", " MAILTO:x", "data:,", "page", "https://x"], U.is_non_fetchable(A)) == [True, True, True, True, False, False]
    assert values(["orchard.test/x", "http://a.b", "ftp://a.b"], U.url_key(U.normalise_target(A))) == ["https://orchard.test/x", "http://a.b/", None]
    assert values(["example.com", "http:x", "a b.c", "./x.y", "HTTPS://x"], U.looks_like_url(A)) == [True, False, False, False, True]


def test_text(values):
    assert values(["ÀB"], X.to_lower(A)) == ["Àb"]
    assert values([" \t\r\n\f\x0bx y\n"], X.trim(A)) == ["x y"]
    assert values(["a,,b"], X.split_on(A, ","), X.split_on(A, ",", False)) == [(["a", "", "b"], ["a", "b"])]
    assert values(["a b/é~"], X.percent_encode(A), X.percent_encode(A, "/")) == [("a%20b%2F%C3%A9~", "a%20b/%C3%A9~")]
    assert values(["a%20b+%zz%C3%A9%", "plain", "%41%4a"], X.percent_decode(A)) == ["a b+%zzé%", "plain", "AJ"]
    assert values(["colour=teal", "colour=plum", "n=3&sort=up"], X.short_hash(A)) == ["3b409bc8", "56407b3c", "8afb9c8f"]
    assert values(["v1.2.3-rc1", "2.10", "x"], X.semver(A)) == [[1, 2, 3], [2, 10, 0], [0, 0, 0]]


def test_sizes_and_durations(values):
    assert values(["1.5k", "10", "2 MiB", "1gb", "x", "", "5q"], X.parse_size(A)) == [1536, 10, 2097152, 1073741824, None, None, None]
    assert values(["30", "1.5s", "2m", "1h", "250ms", "x"], X.parse_duration_ms(A)) == [30000, 1500, 120000, 3600000, 250, None]
    assert values([0, 1023, 1280, 1536, 1048576, 5 << 40], X.human_size(A), schema="a bigint") == ["0 B", "1023 B", "1.2 KB", "1.5 KB", "1.0 MB", "5.0 TB"]
    assert values([999, 1150, 61000], X.human_duration_ms(A), schema="a bigint") == ["999ms", "1.1s", "1m 1s"]
    assert values([0, 1700000000], X.format_unix_time(A), schema="a bigint") == ["unknown", "2023-11-14 22:13:20Z"]


def test_entities(values):
    rows = ["a&amp;b", "&LT;&#65;&#x42;", "&nope; &amp &;", "&#0;", "&toolongentity;", "&#x1F600;"]
    assert values(rows, codec.decode_entities(A)) == ["a&b", "<AB", "&nope; &amp &;", "&#0;", "&toolongentity;", "😀"]
    assert values(["<a href=\"x\">'&"], codec.encode_attribute(A)) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]


def test_css_and_srcset(values):
    assert values(['a\\"b', "a\\"], codec.unescape_css(A)) == ['a"b', "a\\"]
    assert values(['a"b\\c'], codec.escape_css(A)) == ['a\\"b\\\\c']
    got = values(["a.png 1x, b.png 2x,,c.png"], codec.parse_srcset(A))[0]
    assert [tuple(x) for x in got] == [("a.png", "1x"), ("b.png", "2x"), ("c.png", "")]
    assert values(["a.png 1x, b.png 2x,,c.png"], codec.build_srcset(codec.parse_srcset(A))) == ["a.png 1x, b.png 2x, c.png"]
    assert values(["9; url=/later", "3;URL='c d'", "5", "0; url = x y", "1;foo=x", "0;url="], codec.meta_refresh(A)) == ["/later", "c d", None, "x", None, None]
    got = values(["alternate stylesheet", "shortcut icon", "nofollow", "Canonical"], codec.link_rel(A))
    assert [tuple(x) for x in got] == [("html", False), ("image", True), ("other", False), ("html", False)]


def test_classify(values):
    types = ["text/HTML; charset=x", "application/x-javascript", "image/webp", "application/vnd.ms-fontobject", "audio/ogg", "x/y", ""]
    assert values(types, classify.kind_from_content_type(A)) == ["html", "js", "image", "font", "media", "other", "other"]
    assert values(["PNG", ".mjs", "x", ""], classify.kind_from_extension(A)) == ["image", "js", "other", "other"]
    assert values(["text/html", "image/jpg", "x/y"], classify.extension_for_content_type(A)) == [".html", ".jpg", ""]
    assert values([".html", "json", ".png", ".q"], classify.content_type_for_extension(A)) == ["text/html; charset=utf-8", "application/json; charset=utf-8", "image/png", "application/octet-stream"]
    rows = [("", "/a.css", "asset"), ("", "/a", "navigation"), ("text/css", "/a.png", "asset"), ("", "/a.b/c", "asset")]
    assert values(rows, classify.classify(A, B, C)) == ["css", "html", "css", "other"]
    assert values([404, 418], classify.status_phrase(A), classify.is_retryable(A), schema="a int") == [("not found", False), ("http 418", False)]
    assert values([1, 2, 6, 9], classify.backoff_ms(A), schema="a int") == [250, 500, 8000, 8000]
    got = values([(200, "", False), (304, "", False), (404, "", False), (200, "", True), (0, "timeout", False)], classify.outcome(A, B, C), schema="a int, b string, c boolean")
    assert [x["state"] for x in got] == ["done", "unchanged", "failed", "skipped", "failed"]


def test_globs(values):
    cases = [
        ("*.html", "a.html", True), ("*.html", "d/a.html", False), ("**/*.html", "d/e/a.html", False), ("**/*.html", "d/a.html", True), ("**/*.html", "a.html", True),
        ("a?b", "a/b", True), ("", "", False), ("**/docs/*.html", "x/docs/a/docs/c.html", False), ("https://x/**", "https://x/a/b", True), ("a*c*e", "abcde", True), ("a**", "a", True), ("*", "", True), ("a.c", "abc", False),
    ]
    assert values([(p, t) for p, t, _ in cases], patterns.glob_match_columns(A, B)) == [x for *_, x in cases]
    for p, t, x in cases:
        assert patterns.glob_text(p, t) == x, (p, t)
    for p in ("*.html", "a?b", "a*c*e", "a.c"):
        assert values([t for q, t, _ in cases if q == p], patterns.glob_match(p, A)) == [x for q, _, x in cases if q == p]


def test_robots_patterns(values):
    cases = [
        ("/attic/", "/attic/box", True), ("/attic/", "/porch", False), ("/v*/old", "/v2/old/x", False), ("/v*/old", "/v2/old", True),
        ("/*.bak$", "/a/b.bak", True), ("/*.bak$", "/a.bak?x", False), ("/x$", "/x", True), ("/x$", "/xy", False), ("", "/", False), ("/a.b", "/axb", False),
    ]
    assert values([(p, t) for p, t, _ in cases], patterns.robots_matches(A, B)) == [x for *_, x in cases]


def test_paths(values):
    rows = {"u<v|w": "u_v_w", ".": "_dot", "..": "_dotdot", "end. .": "end_", "LPT3.log": "_LPT3.log", "": "_", "...": "_", "é" * 100 + ".html": "é" * 87 + "\ufffd" + ".html"}
    assert values(list(rows), paths.sanitize_component(A)) == list(rows.values())
    home = U.parse(F.lit("https://orchard.test/"))
    cases = [
        ("https://orchard.test/", "html", "index.html"), ("https://orchard.test/pears", "html", "pears.html"), ("https://orchard.test/rows/", "html", "rows/index.html"),
        ("https://orchard.test/find?colour=teal", "html", "find@3b409bc8.html"), ("https://orchard.test/cart.asp", "html", "cart.asp.html"), ("https://img.depot.test/u/v.gif", "image", "_external/img.depot.test/u/v.gif"),
        ("http://img.depot.test:81/code", "js", "_external/http_img.depot.test_81/code.js"), ("https://orchard.test/p%20q/r.css", "css", "p q/r.css"), ("https://orchard.test/%2e%2e/k", "other", "_dotdot/k"),
    ]
    assert values([c[:2] for c in cases], paths.relative_path(U.parse(A), B, home)) == [c[2] for c in cases]
    long = values([("https://orchard.test/" + "d" * 150 + "/" + "e" * 100 + ".html", "html")], paths.relative_path(U.parse(A), B, home))[0]
    assert long.endswith(".html") and "/_long/" in "/" + long and len(long) <= 200
    links = [("index.html", "pears.html", "pears.html"), ("shed/l/x.html", "shed/r/y.html", "../r/y.html"), ("a/x.html", "a/x.html", "x.html"), ("x.html", "a b/c.css", "a%20b/c.css"), ("a/b/c.html", "index.html", "../../index.html")]
    assert values([c[:2] for c in links], paths.relative_link(A, B)) == [c[2] for c in links]
    assert values([("/r", "/r/a"), ("/r", "/r/../x"), ("/r", "/rx")], paths.is_inside(A, B)) == [True, False, False]


def test_json(values):
    deep = lambda n: "[" * n + "]" * n
    texts = ['{"a": 1}', "﻿[1, 2]", '{"a": 1} x', "{", "", '"\\ud83d\\ude00"', deep(100), deep(101), "nul", "null", '{"a":"[[["}', "1 2"]
    assert [x is not None for x in values(texts, J.parse(A))] == [True, True, False, False, False, True, True, False, False, True, True, False]
    rows = ['{"n": 3.5, "t": "x", "f": true, "o": {"t": "y", "n": 2}, "n": 4}', '{"n": "3", "t": 7, "f": "true", "o": []}', "{}"]
    assert values(rows, J.number_at(A, "n", otherwise=9)) == [4.0, 9.0, 9.0]
    tricky = ['{"a":{"t":"x"},"t":5}', '{"t":"first","t":"last"}', '{"t":null}', '{"t":{"u":"v"}}', '{"t":"\\"t\\": \\"q"}', "no"]
    assert values(tricky, J.text_at(A, "t", otherwise="?")) == ["?", "last", "?", "?", '"t": "q', "?"]
    assert values(rows, J.text_at(A, "t", otherwise="?")) == ["x", "?", "?"] and values(rows, J.text_at(A, "o", "t")) == ["y", "", ""]
    assert values(rows, J.flag_at(A, "f")) == [True, False, False] and values(rows, J.number_at(A, "o", "n")) == [2.0, 0.0, 0.0]
    assert values(rows, J.contains(A, "o"), J.contains(A, "o", "t"), J.contains(A, "z")) == [(True, True, False), (True, False, False), (False, False, False)]
