"""WARC round trips with payloads that hold records of their own, over blocks that cut records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkveil.llm import warc

FAKE = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc"
PAGES = [
    (1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "u r\nl", FAKE * 3), (4, "z", None), (5, "z", ""), (6, "q", "é\r\n\r\n" * 50 + FAKE), (7, "k", "WARC/1.0\r\n"), (8, "k", FAKE + "\r\n\r\n"),
    (9, "n", "x" * 99), (10, "n", "x" * 99), (11, "n", FAKE * 3), (12, "big", "y" * 5000 + FAKE), (None, "nul", "x" * 200), (1, "again", "x" * 200),
    *((100 + i, "u", f"p{i} " * (i * 7 % 90) + FAKE * (i % 3)) for i in range(30)),
]


def expected():
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and first[h] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


def pages(spark):
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return table.withColumns({c: F.lit("clash") for c in ("digest", "payload", "id", "value", "file")}).repartition(2)


@pytest.mark.parametrize("block", ["128m", "6k"])
def test_round_trip(spark, block):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], block), spark.conf.set(names[1], "0")
        got = warc.round_trip(pages(spark)).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected()
    payloads = {(h or "").encode() for _, _, h in PAGES}
    assert all(bytes(r.payload) in payloads for r in got if r.record_type == "response")


def test_salted_join_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = warc.round_trip(pages(spark)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected()
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_files_that_are_no_archives_and_broken_ends(spark, tmp_path):
    record = "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "whole.warc").write_bytes((record * 3).encode())
    (tmp_path / "broken.warc").write_bytes((record * 2).encode()[:-7])
    (tmp_path / "other.txt").write_bytes(("garbage " + record).encode())
    got = [(r.file.rsplit("/", 1)[-1], r.at) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("broken.warc", 0), ("whole.warc", 0), ("whole.warc", len(record)), ("whole.warc", 2 * len(record))]


@pytest.mark.parametrize("rows", [warc.BROADCAST_ROWS, 0])
def test_cluster_that_changes_between_the_reads(spark, monkeypatch, rows):
    cores, least, most, cost = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {n: spark.conf.get(n, None) for n in (cores, least, most, cost)}
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
    try:
        spark.conf.unset(least), spark.conf.set(cost, "0"), spark.conf.set(cores, "2")
        lazy = warc.round_trip(pages(spark))
        spark.conf.set(cores, "9")  # the second read would be cut finer
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in lazy.collect()), key=repr) == expected()
        spark.conf.set(most, "2k")
        with pytest.raises(Exception, match="read it again"):
            lazy.select("*").collect()
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
