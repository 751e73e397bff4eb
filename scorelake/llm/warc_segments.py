"""WARC archives with segmented records: written from pages, read back, reassembled and verified.

Writing: a page is an HTTP response whose body is in chunked transfer framing. A block longer than ``segment_bytes`` is split: the
first record keeps its type and segment number 1, ``continuation`` records follow with the next numbers, the identifier of the first
as their origin, and the total length on the last. Of pages with equal payloads the one with the largest ``page_id`` is the response, the
others are ``revisit`` records that refer to it. The text sink writes a record a row; its line separator is the two line ends that
close a record, so every file is a plain WARC file.

Reading: files are parsed by their length fields. Whole records are settled where they are parsed. Segments are
grouped by origin identifier, put in order of segment number, checked for gaps and for the total length, and joined; then the
chunked framing is decoded and the payload digest compared. A group is one page, and only segmented pages are shuffled with
their bytes. Revisits are joined with the records they refer to by identifier.

Defined cases: a null or empty html is an empty payload, equal to every other empty one. A null or odd url is percent-escaped
(null: no target). Pages without an id are archived without one: they revisit a page with an id that has their payload, and are responses where there is none. Rows that share an
id but not the payload are told apart by the payload; rows that share both are numbered, and where their page responds they are responses each. A segment that is missing, repeated, or of the wrong length, or a digest that does not match, fails the job. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, small_batches, stored, text_of
from scorelake.session import shared_dir

CRLF = b"\r\n"
PARTS = "record_type string, page_id long, record_id string, refers string, digest string, payload_bytes long, origin string, segment int, total long, block binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def chunked(body: bytes, size: int = 8192) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = []
    for at in range(0, len(body), size):
        part = body[at:at + size]
        out += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing, which must be complete; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            if not data.endswith(CRLF, at):
                raise ValueError("no end after the last chunk")
            return b"".join(out)
        if data[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk of the wrong length")
        out.append(data[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("response without a header end")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block


def record_id(name: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"


def record_name(page_id: int | None, sha: str, row: int = 0) -> str:
    """Name of a row's record: page, payload, and the number among rows that are equal in both."""
    return f"page:{'-' if page_id is None else page_id}:{sha}:{row}"


def page_records(page_id: int | None, sha: str, row: int, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int, date: str) -> list[bytes]:
    """The records of one page, without the line ends that close them. ``sha`` stands for the payload, ``row`` tells rows with the same page and payload apart."""
    own = record_name(page_id, sha, row)
    name = record_id(own)
    target = None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("X-Page-Id", page_id)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, profile, ("WARC-Refers-To", record_id(record_name(refers_to, sha))), kind], head)]
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, kind], block)]
    out, count = [], -(-len(block) // segment_bytes)
    for number in range(1, count + 1):
        part = block[(number - 1) * segment_bytes:number * segment_bytes]
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, kind, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own}:{number}")), ("WARC-Date", date), ("WARC-Target-URI", target),
                      ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if number == count else None)]
        out.append(_record(fields, part))
    return out


def parse_records(content: bytes):
    """(fields, block) of each record of a file."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in content[at:end].decode("utf-8").split("\r\n")[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        block = content[start:at]
        if content[at:at + 4] != b"\r\n\r\n":
            raise ValueError("record of the wrong length")
        at += 4
        yield fields, block


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16_384, file_records: int = 1_000, least_revisit: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html). Payloads of fewer than ``least_revisit`` bytes are responses always."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    # Which page answers for a payload: largest ids by digest, combined before the shuffle and joined back without the bytes.
    keys = stored(rows.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size"), F.xxhash64("url").alias("tie")), "page-digests")
    answers = stored(keys.groupBy("sha").agg(F.max("page_id").alias("answer")), "page-answers")
    numbered = keys.withColumn("row", F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("tie")) - 1)
    twice = stored(numbered.where("row > 0").select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha")).distinct(), "repeated-pages")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha"))
    others = keys.join(answers, "sha").where(f"answer is not null and not page_id <=> answer and size >= {least_revisit}")
    revisits = stored(others.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "answer").distinct(), "page-revisits")
    tagged = rows.withColumn("sha", F.sha2("html", 256)).join(revisits, same, "left").drop("_page", "_sha").withColumn("row", F.lit(0))
    # Rows with the same page and payload get numbers of their own; almost always there are none, and then nothing is sorted.
    if not twice.isEmpty():
        again = tagged.join(twice, same, "left_semi").withColumn("row", F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url")) - 1)
        tagged = tagged.join(twice, same, "left_anti").unionByName(again)

    def records(batches):
        for batch in batches:
            for page_id, sha, url, html, answer, row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "sha", "url", "html", "answer", "row")]):
                made = page_records(page_id, sha, row, url, html.encode("utf-8", "surrogatepass"), answer, segment_bytes, date)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    made = tagged.select("page_id", "sha", "url", "html", "answer", "row").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: whole responses with their payload's size and digest, segments with their bytes."""
    def parts(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse_records(content.as_py()):
                    number, page = int(f.get("warc-segment-number", 0)), f.get("x-page-id")
                    row = {"record_type": f["warc-type"], "page_id": int(page) if page else None, "record_id": f["warc-record-id"], "refers": f.get("warc-refers-to"),
                           "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "origin": None, "segment": None, "total": None, "block": None}
                    if number:
                        total = f.get("warc-segment-total-length")
                        row |= {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "segment": number, "total": int(total) if total else None, "block": block}
                    elif f["warc-type"] == "response":
                        payload = http_payload(block)
                        if sha1_base32(payload) != row["digest"]:
                            raise ValueError(f"payload of {row['record_id']} has another digest")
                        row["payload_bytes"] = len(payload)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("record_type", pa.string()), ("page_id", pa.int64()), ("record_id", pa.string()), ("refers", pa.string()), ("digest", pa.string()),
                    ("payload_bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(parts, PARTS)


def joined_payload(origin: str, segments: list, total: int) -> tuple[int, str]:
    """Size and digest of the payload whose block is in ``segments``, in order; they must be whole."""
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments of {origin} are missing or repeated")
    block = b"".join(bytes(s["block"]) for s in segments)
    if total != len(block):
        raise ValueError(f"segments of {origin} have {len(block)} bytes, not {total}")
    payload = http_payload(block)
    return len(payload), sha1_base32(payload)


def reassembled(parts: DataFrame) -> DataFrame:
    """(page_id, record_id, payload_bytes, digest) of the segmented records: grouped by origin, in segment order, verified and decoded."""
    grouped = parts.where("origin is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("stated"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"))
    payload = F.udf(joined_payload, "struct<payload_bytes:long,digest:string>", useArrow=False)
    whole = grouped.withColumn("payload", payload("origin", "segments", "total"))
    right = F.when(F.col("payload.digest") == F.col("stated"), F.col("payload.digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload of "), "origin", F.lit(" has another digest"))))
    return whole.select("page_id", F.col("origin").alias("record_id"), F.col("payload.payload_bytes").alias("payload_bytes"), right.alias("digest"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every archived page, from the files alone."""
    small_batches(spark, 4)
    parts = stored(read_parts(spark, path), "warc-parts")
    small_batches(spark, 64)
    responses = stored(
        parts.where("record_type = 'response' and origin is null").select("page_id", "record_id", "payload_bytes", "digest").unionByName(reassembled(parts)), "warc-responses")
    small_batches(spark)
    target = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("digest").alias("stated"))
    revisits = parts.where("record_type = 'revisit'").select("page_id", "refers", "digest").join(target, "refers", "left").select(
        "page_id", "payload_bytes",
        F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(F.raise_error(F.lit("a revisit refers to another payload"))).alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to")
    first = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(revisits)


def warc_query(pages: DataFrame) -> DataFrame:
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
