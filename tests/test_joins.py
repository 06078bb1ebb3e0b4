"""As-of joins, robots rules by their literals, sets of globs, and what is refused at the start."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.functions.patterns import glob_text
from linkloom.operators import scope as C
from linkloom.operators.asof import asof_join
from linkloom.operators.globs import GlobSet, first_glob
from linkloom.operators.robots import allowed_by_trie
from linkloom.plans import mirror as W


def test_asof_takes_the_version_that_held_whatever_the_ranges(spark):
    rng = random.Random(1)
    keys = ["hot"] * 8 + ["a", "b", "c", None]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(0, 200)])) for i in range(700)]
    versions = [(rng.choice(keys), rng.choice([None, *range(0, 200)]), rng.randrange(5)) for _ in range(120)] + [("hot", 50, 3), ("hot", 50, 4), ("never", 1, 1)]

    def held(key, t):
        may = [(s, n) for k, s, n in versions if k == key and s is not None and s <= t]
        return max(may) if may else (None, None)

    want = sorted((i, *(held(k, t) if k is not None and t is not None else (None, None))) for i, k, t in rows)
    left = spark.createDataFrame(rows, "i int, url string, at long").withColumn("version", F.lit("mine")).drop("version").repartition(3)
    right = spark.createDataFrame(versions, "target string, since long, n int").withColumnRenamed("target", "url")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = asof_join(left, right, "url", "at", "since")
            assert sorted(((r.i, r.version and r.version.since, r.version and r.version.n) for r in got.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.version for r in asof_join(left, right.limit(0), "url", "at", "since").select("version").distinct().collect()] == [None]
    assert asof_join(left.limit(0), right, "url", "at", "since").count() == 0


PATTERNS = ["/", "/a", "/a/", "/a/b", "/*b", "/a*b$", "/*.x$", "*z", "/a/*", "*", "/q?x=*", "$", "/a$", "", "/c*d*e", "/é/", "/*é"]


def test_rules_by_their_literals_allow_what_all_rules_do(spark):
    rng = random.Random(2)
    rules = [(f"o{k}", p, rng.random() < 0.5) for k in range(6) for p in rng.sample(PATTERNS, 9)] + [("o1", "/a", True), ("o1", "/a", False)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/x.x", "/x/z", "/q?x=1", "/c1d2e", "/é/y", "/yé", "/other", None]
    rows = [(i, rng.choice([f"o{k}" for k in range(7)] + ["o1"] * 5 + [None]), rng.choice(paths)) for i in range(500)]
    r = spark.createDataFrame(rules, "origin string, pattern string, allow boolean")
    df = spark.createDataFrame(rows, "i int, origin string, path string")
    want = sorted((x.i, x.allowed) for x in C.robots_allowed(df, r).select("i", "allowed").collect())
    for few in (100_000, 0):
        got = allowed_by_trie(df.selectExpr("*", "1 as n", "2 as pattern"), r, broadcast_rules=few)
        assert sorted((x.i, x.allowed) for x in got.collect()) == want and set(got.columns) == {"i", "origin", "path", "n", "pattern", "allowed"}


def test_a_hundred_thousand_rules_of_one_origin(spark):
    rules = spark.range(100_000).selectExpr("'o' as origin", "concat('/d', id, if(id % 3 = 0, '/*.html$', '/')) as pattern", "id % 2 = 0 as allow")
    rows = spark.range(4000).selectExpr("id as i", "'o' as origin", "concat('/d', id * 25, '/x.html') as path")
    got = C.robots_allowed(rows, rules)
    assert {(r.i, r.allowed) for r in got.collect()} == {(i, 25 * i % 2 == 0) for i in range(4000)}


GLOBS = ["*.html", "**/*.html", "**/docs/*.html", "a?b", "/a", "**/x", "http://*/p/**", "**", "*", "", "?", "??", "**/a/**", "*ab*", "é*", "**/", "/"]


def test_a_set_finds_the_first_glob_that_matches():
    rng = random.Random(3)
    texts = ["", "a.html", "d/a.html", "x/docs/a/docs/c.html", "docs/c.html", "a/b", "axb", "/a", "a", "x", "y/x", "http://h/p/q/r", "cabd", "éa", "q/"]
    for _ in range(200):
        patterns = tuple(rng.sample(GLOBS, rng.randrange(1, len(GLOBS))))
        globs = GlobSet(patterns)
        for t in texts:
            assert globs.first(t) == next((k for k, p in enumerate(patterns) if glob_text(p, t)), None), (patterns, t)


def test_scope_is_the_same_with_few_and_many_globs(spark, monkeypatch):
    urls = ["http://h.test/a/b.html", "http://h.test/docs/x.html", "http://h.test/p?page=2", "http://o.test/a", "ftp://h.test/a", "http://h.test/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.parse(F.col("url")).alias("target"), F.lit("navigation").alias("role"), F.lit(0).alias("depth"))
    s = C.Scope(primary="http://h.test/", exclude=("**/docs/*.html", "**page=2", "http://*/a/**"), include=("**html", "**/", "http://h.test/*"))
    few = {r.url: r.reason for r in C.with_scope(rows, "target", "role", "depth", s).collect()}
    monkeypatch.setattr(C, "MANY_GLOBS", 0)
    assert {r.url: r.reason for r in C.with_scope(rows, "target", "role", "depth", s).collect()} == few and len(set(few.values())) >= 4
    monkeypatch.undo()
    sizes = []
    for n in (100, 5000):
        plan = rows.select(first_glob(F.col("url"), tuple(f"**/{k}/*" for k in range(n))))
        sizes.append(len(plan._jdf.queryExecution().toString()))
    assert abs(sizes[0] - sizes[1]) < 100


RESPONSES = "url string, final_url string, status int, headers array<struct<name:string,value:string>>, body binary, truncated boolean, error string"


@pytest.fixture
def responses(spark):
    header = [("Content-Type", "text/html")]
    page = lambda path, text, kind="text/html": (f"http://h.test{path}", "", 200, [("Content-Type", kind)], text.encode(), False, "")
    assert header
    return spark.createDataFrame([page("/private/a", '<a href="/b">b</a>'), page("/b", "b"), page("/", '<a href="/private/a">a</a>'), page("/robots.txt", "User-agent: *\nDisallow: /private", "text/plain")], RESPONSES)


def test_a_start_that_is_refused_leads_nowhere(responses):
    told = lambda m: {r.url: (r.state, r.note) for r in m.manifest.collect()}
    start = "http://h.test/private/a"
    assert told(W.mirror(responses, start, C.Scope())) == {start: ("skipped", "disallowed by robots.txt")}
    assert told(W.mirror(responses, start, C.Scope(exclude=("**private**",), respect_robots=False))) == {start: ("skipped", "matched --exclude **private**")}
    assert [r.url for r in W.list_urls(responses, start, C.Scope()).collect()] == []
    assert told(W.mirror(responses, start, C.Scope(respect_robots=False))) == {start: ("done", ""), "http://h.test/b": ("done", "")}
