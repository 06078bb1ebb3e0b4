"""Pages that share a URL are rows of their own, as in the queries' SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkloom.operators import chunks

URLS = ["http://a.example.com/en/1", "http://a.example.com/en/2?page=2", "https://b.example.net/#top"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Twenty pages each of three URLs and of one of them with another fragment; no two pages are equal."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, URLS[i % 4] if i % 4 < 3 else "http://a.example.com/en/1#x", f'<p>{"é" * (i % 9)}</p><a href="/l{i}">a</a><a href="/same#f">b</a>') for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder


def both(spark, folder, name):
    """The rows of a query and those of its SQL."""
    found = __spark_entry__.queries()[name](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
        wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return Counter(map(tuple, found.collect())), Counter(wanted)


def test_discover_chunked(spark, repeated):
    got, wanted = both(spark, repeated, "discover_chunked")
    assert got == wanted and len(got) == 80 + 4  # the links of every page and one that all have, by URL


def test_bodies_of_one_url_keep_to_their_own_base(spark):
    rows = [(k, "http://h/p", f'<base href="/b{k}/"><a href=x>') for k in range(6)] + [(6, None, "<a href=http://o/y>")]
    cut = chunks.split_bodies(spark.createDataFrame(rows, "id long, url string, body string"), 4)
    edges = chunks.discover_chunks(cut, key="id")
    assert sorted((r.id, r.url, r.target.path) for r in edges.where("id < 6").collect()) == [(k, "http://h/p", f"/b{k}/x") for k in range(6)]
    kept = chunks.chunk_references(cut.withColumn("n", F.col("id") * 2), "id", keep=["url", "n"]).where("link = 0")
    assert sorted((r.id, r.n, r.url is None) for r in kept.collect()) == [(k, 2 * k, k == 6) for k in range(7)]


def test_manifest_upsert(spark, repeated):
    got, wanted = both(spark, repeated, "manifest_upsert")
    assert got == wanted and got.total() == 81 and len({url for url, *_ in got}) == 4


def test_rewrite_manifest(spark, repeated):
    got, wanted = both(spark, repeated, "rewrite_manifest")
    assert got == wanted and got.total() == 80 and len({url for url, *_ in got}) == 3


def test_update_diff(spark, repeated):
    got, wanted = both(spark, repeated, "update_diff")
    assert got == wanted and got.total() == 80 and len({change for _, change in got}) == 3


def test_conditional_headers(spark, repeated):
    got, wanted = both(spark, repeated, "conditional_headers")
    assert got == wanted and got.total() == 80 and len({url for url, *_ in got}) == 3
