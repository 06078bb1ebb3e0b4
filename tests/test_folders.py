"""Folders that tasks list, hash and write; stored responses as a data source."""

import hashlib
import os

import pytest

from linkloom.operators import manifest as M
from linkloom.plans import mirror as W
from linkloom.sources.files import hash_files, list_files, write_files
from linkloom.sources.packs import Folder, PackReader, WebPacks


def test_files_are_listed_and_hashed_by_subtrees(spark, tmp_path):
    want = {}
    for k in range(60):
        at = tmp_path / "top" / f"a{k % 5}" / f"b{k % 3}" / f"{k}.bin"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes([k]) * (k * 4001))
        want[f"a{k % 5}/b{k % 3}/{k}.bin"] = (k * 4001, hashlib.sha256(bytes([k]) * (k * 4001)).hexdigest())
    (tmp_path / "top/first").write_bytes(b"1")
    (tmp_path / "top/.hidden").mkdir()
    (tmp_path / "top/.hidden/x").write_bytes(b"22")
    want["first"] = (1, hashlib.sha256(b"1").hexdigest())
    for folder in (f"file://{tmp_path}/top", f"{tmp_path}/top/"):
        for tasks in (1, 4, 64):
            assert {r.path: (r.size, r.sha256) for r in hash_files(spark, folder, tasks=tasks).collect()} == want
    assert {r.path for r in list_files(spark, f"{tmp_path}/top", hidden=True).collect()} == set(want) | {".hidden/x"}
    assert list_files(spark, f"{tmp_path}/none").count() == 0
    plan = hash_files(spark, f"{tmp_path}/top")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "content" not in plan


def test_a_mirror_is_checked_and_inspected_where_it_lies(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    write_files(spark.createDataFrame([("a.html", b"a"), ("d/b.png", b"bb"), ("d/c.png", b"changed")], "path string, body binary"), folder)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("u1", "a.html", sha(b"a"), 1, "done", "html"), ("u2", "d/b.png", "", 2, "done", "image"), ("u3", "d/c.png", sha(b"cc"), 2, "done", "image"), ("u4", "gone", sha(b"g"), 1, "done", "js"), ("u5", "", "", 0, "failed", "other"), ("u6", "", "", 0, "skipped", "other")]
    M.save_json(M.lenient(spark.createDataFrame(rows, "url string, path string, sha256 string, size long, state string, kind string")), f"{folder}/{W.MANIFEST}")
    checked, summary = W.check_mirror(spark, folder)
    assert {r.url: r.verdict for r in checked.collect()} == {"u1": "verified", "u2": "unverifiable", "u3": "corrupted", "u4": "missing"}
    assert tuple(summary.first()) == (1, 1, 1, 1, False)
    kinds, counts, failed = W.inspect_mirror(spark, folder)
    assert {(r.kind, r.files, r.bytes) for r in kinds.collect()} == {("html", 1, 1), ("image", 2, 4), ("js", 1, 1)}
    disk = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "m") for f in names if not (f.startswith(".") and f.endswith(".crc"))]
    assert tuple(counts.first()) == (6, 1, 1, len(disk), sum(disk)) and [r.url for r in failed.collect()] == ["u5"]
    with pytest.raises(Exception):
        W.check_mirror(spark, f"file://{tmp_path}/other")


def test_of_two_rows_of_a_path_one_is_written_and_told(spark, tmp_path):
    bodies = [b"one", b"two", b"three"]
    rows = spark.createDataFrame([("x", b) for b in bodies] + [("y", b"y")], "path string, body binary").repartition(3)
    told = {r.path: r.sha256 for r in write_files(rows, f"file://{tmp_path}/f").collect()}
    best = max(bodies, key=lambda b: hashlib.sha256(b).hexdigest())
    assert told == {"x": hashlib.sha256(best).hexdigest(), "y": hashlib.sha256(b"y").hexdigest()} and (tmp_path / "f/x").read_bytes() == best


RESPONSES = "url string, final_url string, status int, headers array<struct<name:string,value:string>>, body binary, truncated boolean, error string"


def _responses(spark, urls, body=b"b"):
    return spark.createDataFrame([(u, None, 200, [("A", "é"), ("A", "2")], None if u.endswith("0") else body + u.encode(), False, "") for u in urls], RESPONSES)


def _load(spark, folder, **options):
    return spark.read.format("webpacks").options(path=folder, **options).load()


def test_packs_hold_what_was_written_and_filters_choose_packs(spark, tmp_path):
    spark.dataSource.register(WebPacks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder, urls = f"{tmp_path}/w", [f"http://h/{k:03d}" for k in range(90)]
    assert _load(spark, folder).count() == 0
    given = _responses(spark, urls)
    given.repartitionByRange(6, "url").write.format("webpacks").option("path", folder).mode("append").save()
    plain = lambda df: sorted((r.url, r.final_url, r.status, tuple(map(tuple, r.headers)), None if r.body is None else bytes(r.body), r.truncated, r.error) for r in df.collect())
    assert plain(_load(spark, folder)) == plain(given)
    found = _load(spark, folder).where("url = 'http://h/011'")
    assert plain(found) == plain(given.where("url = 'http://h/011'")) and found.rdd.getNumPartitions() == 1
    assert _load(spark, folder).where("url like 'http://h/01%'").count() == 10 and _load(spark, folder).where("url in ('http://h/001', 'http://h/089', 'x') and status = 200").count() == 2
    reader = PackReader(folder, 0)
    assert len(reader.partitions()) == 6
    more = _responses(spark, ["http://i/1"], b"new")
    more.write.format("webpacks").option("path", folder).mode("append").save()
    assert _load(spark, folder).count() == 91 and _load(spark, folder, version="1").count() == 90
    more.write.format("webpacks").option("path", folder).mode("overwrite").save()
    assert [r.url for r in _load(spark, folder).collect()] == ["http://i/1"] and Folder(folder).last() == 3


def test_a_job_that_fails_leaves_the_last_version_whole(spark, tmp_path):
    spark.dataSource.register(WebPacks)
    folder = f"{tmp_path}/w"
    _responses(spark, ["http://h/1", "http://h/2"]).write.format("webpacks").option("path", folder).mode("append").save()
    before = sorted(os.listdir(f"{folder}/data"))
    broken = _responses(spark, [f"http://h/{k}" for k in range(40)]).repartition(4).selectExpr("if(url = 'http://h/33', raise_error('torn'), url) as url", "body")
    with pytest.raises(Exception, match="torn"):
        broken.write.format("webpacks").option("path", folder).mode("overwrite").save()
    assert {r.url for r in _load(spark, folder).collect()} == {"http://h/1", "http://h/2"} and sorted(os.listdir(f"{folder}/data")) == before
    with pytest.raises(Exception, match="rows need"):
        spark.range(1).write.format("webpacks").option("path", folder).mode("append").save()


def test_a_stream_of_packs_takes_each_version_once(spark, tmp_path):
    spark.dataSource.register(WebPacks)
    folder, out = f"{tmp_path}/w", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.format("webpacks").option("path", folder).load().select("url", "status")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    _responses(spark, ["http://h/1", "http://h/2"]).write.format("webpacks").option("path", folder).mode("append").save()
    assert run() == ["http://h/1", "http://h/2"]
    _responses(spark, ["http://h/3"]).write.format("webpacks").option("path", folder).mode("append").save()
    assert run() == ["http://h/1", "http://h/2", "http://h/3"] == run()


def test_the_document_is_that_of_one_task(spark, tmp_path):
    rows = [(f"http://h/{k}?\"q\"=é", f"p{k}" if k % 3 else None, k, "done" if k % 2 else "failed") for k in range(120)]
    m = M.lenient(spark.createDataFrame(rows, "url string, path string, size long, state string")).repartition(7)
    M.save_document(m, f"file://{tmp_path}/m.json", "http://h/ü", 5, 6)
    text = M.document_text(m, "http://h/ü", 5).first()[0]
    want = text.replace(text.split('"updated_at" : ')[1].split(",")[0], "6", 1)
    assert (tmp_path / "m.json").read_bytes() == want.encode()
    head, back = M.load_document(spark, f"file://{tmp_path}/m.json")
    assert head["updated_at"] == 6 and back.exceptAll(m).isEmpty() and back.count() == 120
    M.save_document(m.limit(0), f"file://{tmp_path}/m.json", "s", 5, 6)  # over the old one
    assert M.load_document(spark, f"file://{tmp_path}/m.json")[1].count() == 0


def test_table_functions_say_what_they_do_not_take(spark):
    from linkloom.functions import tables

    tables.register(spark)
    assert spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING)) AS t(h), LATERAL page_references(t.h)").count() == 0
    assert spark.sql("SELECT r.value FROM VALUES (CAST('<a href=\"/x\">' AS BINARY)) AS t(h), LATERAL page_references(t.h) AS r").first()[0] == "/x"
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM VALUES (1) AS t(h), LATERAL page_references(t.h)").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM VALUES ('a', 'b') AS t(h, g), LATERAL robots_rules(t.h, t.g)").collect()
