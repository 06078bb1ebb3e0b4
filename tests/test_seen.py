"""The filter of what a frontier has seen."""

import random

from pyspark.sql import functions as F

from linkloom.operators import frontier
from linkloom.operators.seen import Seen, SeenFilter


def _urls(spark, names):
    return spark.createDataFrame([(x,) for x in names], "url string")


def test_filter_holds_what_was_added_and_little_else(spark):
    old, new = [f"http://a/{i}" for i in range(3000)] + [None, ""], [f"http://b/{i}" for i in range(3000)]
    for blocks in (1 << 14, 0):  # broadcast, and joined by block
        f = SeenFilter(4000, broadcast_blocks=blocks)
        assert not any(r.maybe for r in f.marked(_urls(spark, old[:5])).collect())
        f.add(_urls(spark, old[:1000]), 1000)
        f.add(_urls(spark, old[1000:]), 2002)  # merged
        told = f.marked(_urls(spark, old + new))
        assert told.columns == ["url", "maybe"]
        rows = told.collect()
        assert all(r.maybe for r in rows if r.url is None or not r.url.startswith("http://b"))
        assert sum(r.maybe for r in rows) < 3002 + 60 and f.held == 3002 and not f.full


def test_a_filter_that_is_too_small_loses_nothing(spark):
    """Every place may be taken; then all go to the exact join."""
    seen = Seen(_urls(spark, ["x"]), filter_from=0)
    seen.filter = SeenFilter(1)
    seen.filter.add(_urls(spark, [f"f{i}" for i in range(20000)]), 1)  # full of what the rounds don't have
    assert {r.url for r in seen.new(_urls(spark, ["x", "y", "z"])).collect()} <= {"x", "y", "z"}
    seen.filter.add(_urls(spark, ["x"]), 0)
    assert {r.url for r in seen.new(_urls(spark, ["x", "y", "z"])).collect()} == {"y", "z"}


def test_frontier_is_one_with_and_without_the_filter(spark):
    draw = random.Random(5)
    edges = [(f"u{draw.randrange(40)}", f"u{draw.randrange(60)}", draw.choice(["navigation", "asset"]), k) for k in range(500)]
    links = spark.createDataFrame(edges, "src string, dst string, role string, pos int").withColumn("reason", F.when(F.col("dst") == "u7", "refused"))
    seeds = _urls(spark, ["u1", "u2"])
    plain, filtered = (sorted(map(tuple, frontier.expand(seeds, links, 1, filter_from=n).collect()), key=str) for n in (1 << 60, 0))
    assert plain == filtered and len(plain) > 40


def test_filter_grows_with_the_rounds(spark):
    seen = Seen(_urls(spark, ["a"]), filter_from=0, many=2)
    assert seen.new(_urls(spark, ["a", "b"])).collect()[0].url == "b" and seen.filter.room == 2
    for k in range(4):
        seen.add(_urls(spark, [f"{k}-{i}" for i in range(4)]))
    assert seen.n == 17 and seen.filter.full
    assert [r.url for r in seen.new(_urls(spark, ["a", "3-3", "new"])).collect()] == ["new"]
    assert seen.filter.room == 34 and seen.add(_urls(spark, []).limit(0)) == 0
