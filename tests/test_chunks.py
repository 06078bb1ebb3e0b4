"""Bodies in chunks give what whole bodies give, wherever they are cut."""

import random

from pyspark.sql import functions as F

from linkloom.operators import chunks, links, scan
from linkloom.sources.files import read_chunks

PAGES = [
    b"<!doctype html><head><base href=/b/><title>a < b</title></head><!-- <a href=no> --><a href='x?a&amp;b'>\xc3\xa9</a>",
    b"<style>@import 'i.css'; a{b:url( q.png )}</style><img srcset='a 1x, b 2x' style=\"c:url('z')\"><meta http-equiv=refresh content='0; url=n.html'>",
    b"<script>if (a < b) '</scrip'; </script ><a href=late><!---><a href=no>--><script><a href=never-closed>",
    b"<a href=x", b"<!-", b"<!--", b"", b"<a =b href=c/ >t<",
]
SHEETS = [b"@import  'a.css';/* url(no) */ x{y:url(b\\)c.png)} '/*' z{w:x-url(no) url(\"d e\")}", b"/*/ url(no)", b"url(", b"@import url(e.css)", b"a{b:URL  ( f )}"]


def _fed(scanner, parts):
    return [x for i, p in enumerate(parts) for x in scanner.feed(p, i == len(parts) - 1)]


def test_every_cut_gives_the_whole_scan():
    for page in PAGES:
        found, base, _ = scan.html_links(page)
        for i in range(len(page) + 1):
            for j in range(i, len(page) + 1, 7):
                s = scan.HtmlScanner()
                assert (_fed(s, [page[:i], page[i:j], page[j:]]), s.base) == (found, base)
        s = scan.HtmlScanner()
        assert _fed(s, [*(page[i : i + 1] for i in range(len(page))), b""]) == found
    for sheet in SHEETS:
        for i in range(len(sheet) + 1):
            for j in range(i, len(sheet) + 1):
                assert _fed(scan.CssScanner(), [sheet[:i], sheet[i:j], sheet[j:]]) == scan.css_links(sheet)


def test_what_is_passed_over_is_not_held():
    html, css = scan.HtmlScanner(), scan.CssScanner()
    html.feed(b"<!-- ")
    css.feed(b"a{} /* ")
    for _ in range(50):
        assert html.feed(b"<a href=no> -- " * 100) == [] and css.feed(b"url(no) * " * 100) == []
        assert len(html._held) < 8 and len(css._held) < 8
    assert html.feed(b"--><a href=x>")[0][:3] == (5 + 50 * 1500 + 11, 1, "x") and css.feed(b"*/url(y) ", True)[0][:3] == (7 + 50 * 1000 + 6, 1, "y")


def test_edges_of_chunks_are_those_of_whole_bodies(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"http://h/{k}/{draw.random()}", p) for k, p in enumerate(PAGES)] + [("http://h/null", None)]
    whole = spark.createDataFrame(rows, "url string, body binary")
    shape = lambda df: sorted((r.url, r.link, r.part, r.role, r.hint, r.target.path) for r in df.collect())
    cut = chunks.split_bodies(whole.withColumn("further", F.lit(1)), 5).withColumn("role", F.lit("clash"))
    assert shape(chunks.discover_chunks(cut)) == shape(links.discover_html(whole, "url", "body")) != []
    sheets = spark.createDataFrame([(f"http://h/s{k}", s) for k, s in enumerate(SHEETS)], "url string, body binary")
    found = chunks.discover_chunks(chunks.split_bodies(sheets, 3), sheets=True)
    plain = links.discover_css(sheets, "url", "body")
    assert sorted((r.url, r.link, r.hint, r.target.path) for r in found.collect()) == sorted((r.url, r.link, r.hint, r.target.path) for r in plain.collect()) != []
    for k, p in enumerate(PAGES):
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"{k}.html").write_bytes(p)
    told = read_chunks(spark, str(tmp_path), 4, tasks=2).groupBy("path").agg(F.max("chunk").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bytes"))), lambda x: F.hex(x["bytes"])), "").alias("hex"))
    assert {(r.path, r.last, r.hex) for r in told.collect()} == {(f"d{k % 2}/{k}.html", max(0, len(p) - 1) // 4, p.hex().upper()) for k, p in enumerate(PAGES)}
