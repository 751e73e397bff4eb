"""Digests of files of any size: ranges of bytes are hashed apart and their digests hashed together.

A file is cut into chunks of fixed size. Every chunk is hashed by itself, ``fan`` consecutive digests are hashed into one, and the file's digest is that of its
length and those. The chunks of one file are spread over tasks, each of which opens the file, goes to its range and reads it in small pieces; what is gathered per file is one
digest for every ``fan`` chunks. The digest depends on the content, the chunk size and the fan only, not on how chunks were dealt to tasks, nor on which way the bytes were read.
"""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, FAN = 8 << 20, 1024
_PIECE = 1 << 20


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files; Spark lists them, their content is not read. It passes over files without any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def _uri(path: str) -> str:
    """The path as the range reader knows it: Hadoop gives names as they are, local paths with one slash, and one store another name."""
    scheme, rest = path.split(":", 1)
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}"


def _chunk_digests(files: DataFrame, chunk: int, task_bytes: int) -> DataFrame:
    """(path, length, nth, digest) of every chunk."""
    last = F.ceil(F.col("length") / chunk) - 1
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("nth"))
    total = files.agg(F.sum("length")).first()[0] or 0
    # A stated number of parts: the rows are tiny, the bytes behind them are not.
    dealt = chunks.repartition(int(min(100_000, max(1, -(-total // task_bytes)))), "path", "nth")

    def digests(batches):
        from pyarrow import fs

        open_path, file = None, None
        for batch in batches:
            found = []
            for path, nth in zip(batch.column("path").to_pylist(), batch.column("nth").to_pylist()):
                if path != open_path:
                    store, name = fs.FileSystem.from_uri(_uri(path))
                    open_path, file = path, store.open_input_file(name)
                digest, at, end = hashlib.sha256(), nth * chunk, min((nth + 1) * chunk, file.size())
                while at < end:
                    piece = file.read_at(min(_PIECE, end - at), at)
                    if not piece:
                        raise OSError(f"{path} ends before its listed length")
                    digest.update(piece)
                    at += len(piece)
                found.append(digest.hexdigest())
            yield batch.append_column("digest", pa.array(found, pa.string()))

    return dealt.mapInArrow(digests, "path string, length long, nth long, digest string")


def _whole_digests(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """The same from files that are read as a whole, by Spark's own reader: for stores that the range reader does not know, up to 2 GB a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    last = (F.ceil(F.col("length") / chunk) - 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col("content"), i * chunk + 1, F.lit(chunk)), 256))
    return files.select("path", "length", F.posexplode(parts).alias("nth", "digest"))


def _joined(items: str) -> Column:
    """Digest of the digests of collected (place, digest) pairs, in order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.col(items)), lambda x: x["digest"]), ""), 256)


def tree_fingerprints(spark: SparkSession, path: str, chunk: int = CHUNK, fan: int = FAN, task_bytes: int = 256 << 20, ranges: bool = True) -> DataFrame:
    """(path, length, tree_sha256) of every file under ``path``. ``ranges=False`` reads files as a whole."""
    leaves = _chunk_digests(listed_files(spark, path), chunk, task_bytes) if ranges else _whole_digests(spark, path, chunk)
    pair = lambda place: F.collect_list(F.struct(place.alias("at"), F.col("digest"))).alias("parts")
    blocks = leaves.groupBy("path", "length", F.floor(F.col("nth") / fan).alias("block")).agg(pair(F.col("nth"))).select(
        "path", "length", "block", _joined("parts").alias("digest"))
    files = blocks.groupBy("path", "length").agg(pair(F.col("block")))
    whole = F.concat(F.col("length").cast("string"), F.lit(":"), F.array_join(F.transform(F.sort_array("parts"), lambda x: x["digest"]), ""))
    return files.select("path", "length", F.sha2(whole, 256).alias("tree_sha256"))


def table_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """(files, bytes, sha256) over a folder's file digests by their paths within it."""
    name = F.regexp_replace("path", r"^.*" + root.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/", "")
    row = F.sha2(F.concat_ws("\u0001", name, F.col("length").cast("string"), F.col("tree_sha256")), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("files", "bytes", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("files", "bytes", "a", "b")]), 256).alias("sha256"))
