import base64
import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.llm import warc_segments as W
from scorelake.session import shared_dir

PAGES = "page_id long, url string, html string"


def rows():
    rng = random.Random(2)
    big = "".join(rng.choice("abc\r\n<é>") for _ in range(60_000))
    return [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/ü\r\nX: y", None), (4, "u", ""), (5, "u", big), (6, "u", big + "!"), (7, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (9, "u", "0\r\n\r\n")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("size", [300, 16_384])
def test_round_trip(spark, size):
    path = shared_dir(spark, "warc-test")
    df = spark.createDataFrame(rows(), PAGES).select("*", F.lit(1).alias("answer"), F.lit(2).alias("row"), F.lit(3).alias("block"))
    W.write_archives(df, path, segment_bytes=size, file_records=50)
    got = {r.page_id: r for r in W.read_archives(spark, path).collect()}
    assert len(got) == len(rows())
    for i, _, html in rows():
        last = max(p for p, _, h in rows() if (h or "") == (html or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((html or "").encode()), digest(html))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last == i else ("revisit", last))


def test_records_are_plain_warc(spark):
    path = shared_dir(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows(), PAGES), path, segment_bytes=1000)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).collect()]
    records = [r for f in files for r in W.parse_records(f)]
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds.count("continuation") > 50 and kinds.count("revisit") == 3
    last = [f for f, _ in records if "warc-segment-total-length" in f]
    assert len(last) == 2 and all(int(f["warc-segment-number"]) > 1 for f in last)


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 8192, 20_000):
        body = rng.randbytes(n)
        assert W.unchunked(W.chunked(body)) == body and W.unchunked(W.chunked(body, 7)) == body
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n0"):
        with pytest.raises(ValueError):
            W.unchunked(bad)


def test_broken_segments_fail(spark):
    path = shared_dir(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows()[4:5], PAGES), path, segment_bytes=1000)
    parts = W.read_parts(spark, path)
    for broken in (parts.where("segment <> 3"), parts.union(parts.where("segment = 2")), parts.withColumn("total", F.col("total") + 1)):
        with pytest.raises(PySparkException):
            W.reassembled(broken).collect()


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (0, "b", "x"), (None, "c", "x"), (2, "a", "y" * 40_000), (2, "a", "y" * 40_000)], PAGES)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.warc_query(df).collect()), key=str)
    assert got == [(0, "revisit", 1, 1), (1, "response", None, 1), (1, "response", None, 1), (2, "response", None, 40_000), (2, "response", None, 40_000), (None, "revisit", 1, 1)]
    assert W.warc_query(df.limit(0)).count() == 0


def test_one_id_with_several_payloads(spark):
    """Long payloads are segmented, short ones revisited; ids, and rows without one, repeat in every way."""
    a, b = "p" * 40_000, "q" * 40_000
    rows = [(1, "u", a), (1, "u", b), (1, "v", a), (2, "u", "s"), (2, "u", "t"), (3, "u", "s"), (0, "u", b), (None, "u", a), (None, "u", None), (None, "w", None), (None, "u", "only " * 9000)]
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in W.warc_query(spark.createDataFrame(rows, PAGES)).collect()]
    want = []
    for page, _, html in rows:
        answer = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want.append((page, digest(html), "response" if answer is None or page == answer else "revisit", None if page == answer else answer))
    assert sorted(got, key=str) == sorted(want, key=str)
