"""Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import common, decontaminate, lm, mixing, neardup, pii, quality, secret_scan, substrings, toxicity, warc

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "one two three", "en", "a", 9), (3, "one two three", "en", "a", 9), (None, "one two three four five six", "de", "b", 9), (5, LONG, None, "b", None), (6, " \t\n ", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(7) for c in ("size", "kept", "n_words", "score", "h1", "n", "vertex", "host", "share", "place", "target", "taken", "segs", "row", "start", "pii", "_0", "count")}
    return plain.withColumns(clash)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "zz yy xx ww vv. uu tt."), (2, None), (3, ""), (4, "zz yy xx ww vv. uu tt.")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda d, i, l: toxicity.toxicity(d, l),
    "op2": lambda d, i, l: substrings.substring_dedup(d),
    "op3": lambda d, i, l: pii.pii_report(d, pii.Pseudonyms(key=b"test")),
    "op5": lambda d, i, l: mixing.mixture(d),
    "op6": lambda d, i, l: secret_scan.secrets(d),
    "op7": lambda d, i, l: quality.quality(d),
    "op9": lambda d, i, l: lm.lm_scores(d),
    "op9 by slices": lambda d, i, l: lm.lm_scores(d, lm.Settings(broadcast_bytes=-1)),
    "op10": lambda d, i, l: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_document(docs, items, labels, name):
    got = sorted(str(r.doc_id) for r in RUNS[name](docs, items, labels).collect())
    assert got == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, items, labels, name):
    assert RUNS[name](docs.limit(0), items, labels).count() == 0


def test_pairs_and_pages(spark, docs, items):
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == decontaminate.contaminated(docs, items.limit(0)).count() == 0
    dirty = docs.withColumn("text", F.when(F.col("doc_id") == 3, "q ZZ yy, xx ww vv. uu tt! r").otherwise(F.col("text")))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(dirty, items).collect()) == [(3, 1), (3, 1), (3, 4), (3, 4)]
    pages = spark.createDataFrame([(1, None, None), (2, "u\r\nx", "a" * 200), (3, "v", "a" * 200), (3, "v", "a" * 200), (4, "w", ""), (None, "q", "a" * 200), (5, "z", "a" * 99), (6, "z", "a" * 99)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(spark, pages).collect()}
    assert got == {(1, "response", None, 0), (2, "response", None, 200), (3, "revisit", 2, 200), (4, "response", None, 0), (None, "revisit", 2, 200), (5, "response", None, 99), (6, "response", None, 99)}
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_stages_keep_columns(spark, docs, sf):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == none.columns == docs.columns, name
        assert none.count() == 0, name
        ids = sorted(str(r.doc_id) for r in out.collect())
        want = {"quality rules": [], "near duplicates": ["1", "2", "3", "5", "6", "None"]}.get(name)
        assert ids == want if want is not None else set(ids) <= {str(r[0]) for r in ROWS}, name


def test_intermediate_tables_can_be_dropped(spark, docs):
    neardup.near_duplicates(docs).count()
    assert common.drop_tables(spark) > 0 and common.drop_tables(spark) == 0
