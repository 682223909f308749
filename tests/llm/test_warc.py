"""WARC archives: round trips, revisits, and the order of the merged index."""

from __future__ import annotations

import base64
import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from emberlog.llm import warc

SCHEMA = "page_id long, url string, html string, _row long, _time string, record string, _metadata string"


def made_rows():
    rng = random.Random(5)
    bodies = [
        None, "", "x", "naïve ☃ \U0001f600", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc",
        "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n", "WARC-Boundary: ", "ends in returns\r\n\r\n\r\n", "big " * 200_000, "\x00 nul",
    ]
    urls = ["http://B.example.com/p?q=1#f", "https://www.example.org:443/", "http://example.org:8080/a\r\nX: y", None, "", "nonsense"]
    rows = [(i, rng.choice(urls), b, 1, "t", "r", "m") for i, b in enumerate(bodies)]
    rows += [(100 + i, rng.choice(urls), rng.choice(bodies[:6]), 1, "t", "r", "m") for i in range(60)]
    # repeated ids and rows, rows without an id
    rows += [(150, "http://a.example/", "again", 1, "t", "r", "m")] * 3 + [(149, None, "again", 1, "t", "r", "m")]
    rows += [(None, "http://a.example/", "no id", 1, "t", "r", "m")] * 2 + [(None, None, "again", 1, "t", "r", "m")]
    return rows


@pytest.fixture(params=["files", "frame"])
def pages(request, spark, tmp_path):
    df = spark.createDataFrame(made_rows(), SCHEMA).repartition(4)
    if request.param == "frame":
        return df
    df.write.parquet(str(tmp_path / "pages"))
    return spark.read.parquet(str(tmp_path / "pages"))


def test_round_trip(spark, pages):
    archive = warc.write_archive(pages)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("900", "100000", "134217728"):  # records begin and end anywhere in a split
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = warc.read_archive(spark, archive).collect()
            stored = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
            got = sorted((str(r.page_id), stored[r.payload_digest]) for r in back)
            assert got == sorted((str(r[0]), (r[2] or "").encode()) for r in made_rows())
            assert all(r.payload is None for r in back if r.record_type == "revisit")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert {r.captured.year for r in back} == {1970}
    assert {r.url for r in back} >= {"http://example.org:8080/a%0D%0AX: y"}


def test_revisits(spark, pages):
    rows = made_rows()
    back = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert len(back) == len(rows)
    by_body = {}
    for i, _, body, *_ in rows:
        by_body.setdefault((body or "").encode(), []).append(i)
    for body, ids in by_body.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        largest = max(ids, key=lambda i: (i is not None, i))
        own = [r for r in back if r.payload_digest == digest]
        assert [r.page_id for r in own if r.record_type == "response"] == [largest]
        assert {r.payload_bytes for r in own} == {len(body)}
        assert all(r.refers_to == largest for r in own if r.record_type == "revisit")


def test_small_payloads_may_be_stored_each_time(spark, pages):
    back = warc.read_archive(spark, warc.write_archive(pages, revisit_from=5)).collect()
    assert {r.record_type for r in back if r.payload_bytes < 5} == {"response"}
    assert "revisit" in {r.record_type for r in back if r.payload_bytes >= 5}


def test_index_is_in_order(spark, pages):
    captured = F.timestamp_seconds(F.col("page_id") % 7)
    archive = warc.write_archive(pages, time=captured)
    captures = warc.read_archive(spark, archive)
    index = warc.merged_index(warc.sorted_runs(captures), range_rows=10).collect()
    key = lambda r: (r.urlkey, r.captured, r.page_id is not None, r.page_id or 0, r.record)
    placed = sorted(index, key=lambda r: (r.range, r.place))
    assert placed == sorted(index, key=key) and len(index) == len(made_rows())
    assert len({r.range for r in index}) > 3


def test_damage_ends_the_job(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://a/", "some payload")], "page_id long, url string, html string")
    archive = warc.write_archive(docs)
    text = spark.read.text(archive.path, wholetext=True).first()[0]
    broken = str(tmp_path / "broken")
    spark.createDataFrame([(text.replace("some payload", "gone payload"),)], "value string").write.text(broken)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, warc.Archive(broken, archive.boundary)).collect()


def test_no_pages(spark, pages):
    assert warc.archive_and_index(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30), j) for j in range(rng.randrange(0, 20))) for _ in range(k)]
    at = [0] * k
    out = []
    for run in warc.loser_tree_merge(runs):
        out.append(runs[run][at[run]])
        at[run] += 1
    assert out == list(heapq.merge(*runs))


def test_url_keys(spark):
    cases = {
        "http://Www.Example.com/A?b=c#d": "com,example,www)/A?b=c",
        "https://u:p@example.org:443": "org,example)/",
        "http://example.org:8080?x": "org,example:8080)/?x",
        "//example.org/y": "org,example)/y",
        "mailto:me": "mailto:me",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", warc.url_key(F.col("url")).alias("k"))
    assert {r.url: r.k for r in df.collect()} == cases
