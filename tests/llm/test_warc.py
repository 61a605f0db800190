from __future__ import annotations

import gzip
import hashlib
import io
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import warc
from ledgerline.llm.queries import ORACLE_SQL, QUERIES
from ledgerline.sources.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def brute(pages: list[tuple]) -> Counter:
    """From (page_id, html) rows."""
    groups: dict[bytes, list] = {}
    for page_id, html in pages:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = Counter()
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        digest = warc.base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            revisit = top is not None and i != top
            out[(i, len(payload), digest, "revisit" if revisit else "response", top if revisit else None)] += 1
    return out


def rows(df) -> Counter:
    return Counter(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


def test_query_against_brute_force_and_sql(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = rows(QUERIES["op6_warc"](spark, FOLDER))
    assert got == brute([(r.page_id, r.html) for r in pages])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    assert got == Counter(con.sql(ORACLE_SQL["op6_warc"]).fetchall())


def test_odd_pages(spark):
    pages = [
        (1, "http://a/\r\nX-Page-ID: 9", "x"), (2, None, None), (3, "http://b/", ""), (4, "http://c/", "x"),
        (4, "http://c/", "x"), (None, "http://d/", "x"), (None, "http://e/", "only"), (7, "http://é/", "é\r\n\r\nWARC/1.1"),
        (8, "http://f/", "z" * 3_000_000),
    ]
    table = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 AS archive", "'k' AS response", "2 AS offset")
    space = Workspace(spark, "t")
    assert rows(warc.round_trip(table, space)) == brute([(p, h) for p, _, h in pages])
    empty = spark.createDataFrame([], PAGES)
    assert warc.round_trip(empty, Workspace(spark, "t")).count() == 0


def test_a_large_group_of_copies(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'same', cast(id AS string)) AS html")
    got = rows(warc.round_trip(pages, Workspace(spark, "t")))
    assert got == brute([(r.page_id, r.html) for r in pages.collect()])
    assert sum(n for r, n in got.items() if r[3] == "revisit") == 999


def test_archives_are_plain_warc_and_selected_records_alone_are_read(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat('ab ', id) AS html")
    space = Workspace(spark, "t")
    index = warc.write_archives(pages.coalesce(1), space, archive_bytes=2000)
    files, root = warc.fs.FileSystem.from_uri(space.path("archives"))
    names = {r.archive for r in index.select("archive").distinct().collect()}
    assert len(names) > 1
    ids = []
    for name in names:
        whole = gzip.GzipFile(fileobj=io.BytesIO(files.open_input_file(f"{root}/{name}").read())).read()
        for part in whole.split(b"WARC/1.1\r\n")[1:]:
            fields = dict(x.split(": ", 1) for x in part.split(b"\r\n\r\n")[0].decode().split("\r\n"))
            ids.append(int(fields["X-Page-ID"]))
            assert fields["WARC-Target-URI"] == f"http://h/{ids[-1]}"
    assert sorted(ids) == list(range(50))
    some = warc.read_records(index.where("page_id IN (3, 4, 40)"), space).collect()
    assert {(r.page_id, bytes(r.payload)) for r in some} == {(i, b"ab " * i) for i in (3, 4, 40)}


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], PAGES)
    index = warc.write_archives(pages, Workspace(spark, "t"), least_revisit_bytes=3)
    assert {r.page_id: r.record_type for r in index.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_neighbouring_ranges_become_one_read():
    assert warc.reads([(0, 10), (10, 10), (25, 5), (100, 5)], 5, 1000) == [(0, 30, [0, 1, 2]), (100, 5, [3])]
    assert warc.reads([(0, 10), (10, 10)], 5, 15) == [(0, 10, [0]), (10, 10, [1])]


def test_damage_is_found():
    raw, _ = warc.record(1, "u", b"payload")
    with pytest.raises(ValueError, match="differ"):
        warc.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(ValueError, match="whole"):
        warc.parse(raw[:-3])


def test_read_tasks_follow_the_bytes(spark):
    """However few bytes index rows have, and however many records one archive holds."""
    pages = spark.range(400).selectExpr(
        "id AS page_id", "concat('http://p/', id) AS url", "concat(id, sha2(string(id), 512), sha2(string(-id), 512)) AS html"
    )
    space = Workspace(spark, "t")
    index = warc.write_archives(pages.coalesce(2), space)
    total = index.agg(F.sum("length")).first()[0]
    read = warc.read_records(index, space, task_bytes=total // 8)
    per_task = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 8 and sum(per_task) == 400 and max(per_task) < 100
