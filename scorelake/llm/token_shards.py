"""Token-id shards: one concatenated id array a file, with document boundaries and ids in Elias-Fano form.

A shard file is, in little-endian order: the mark ``SLSHARD1``; a header of eleven 64-bit numbers (partition, shard, bytes per id, documents,
documents without an id, ids, base of the document ids, and low-bit count and upper bound of either sequence); the boundaries (where each document ends); the document ids
less their base; the token ids; a closing line feed. A sequence of n numbers up to u keeps log2(u / n) low bits of each as they are and the high
parts as unary gaps in a bit row, with the place of every 256th one as a 32-bit number: ``select`` goes there and counts on.
That is about two bits a document above the low bits; no table of 64-bit offsets is kept.

Files are written by Spark's text sink, whose rows are byte strings (the closing line feed is its line separator) and whose commit
lets one attempt of a task only take effect. Documents are range-partitioned and sorted by id, so partition and shard number give the
ascending order. A text is tokenized word by word, each distinct word once in a bounded cache, since the tokenizer never
joins what ASCII white space separates; tests hold this against whole texts.

Defined cases: null and empty texts are the end id alone. Documents without an id come first. Repeated rows are written as often as they
occur, in the order of their text's hash. An empty table writes no file and gives an empty result. Other columns are not stored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, small_batches, stored, text_of
from scorelake.session import shared_dir

MARK = b"SLSHARD1"
HEADER = struct.Struct("<11q")
SAMPLE = 256
END_ID = 2


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 to ``bound``."""

    def __init__(self, n: int, low_bits: int, bound: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low_bits, self.bound = n, low_bits, bound
        self.lows, self.highs, self.samples = lows, highs, samples

    @staticmethod
    def sizes(n: int, low_bits: int, bound: int) -> tuple[int, int, int]:
        """Bytes of the low bits, the unary row and the samples."""
        return (n * low_bits + 7) // 8, (n + (bound >> low_bits) + 1 + 7) // 8, 4 * ((n + SAMPLE - 1) // SAMPLE)

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        values, n = values.astype(np.int64), len(values)
        low_bits = max(0, (bound // n).bit_length() - 1) if n else 0
        lows = b""
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits)) & 1
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> low_bits) + np.arange(n)
        row = np.zeros(8 * cls.sizes(n, low_bits, bound)[1], dtype=np.uint8)
        row[places] = 1
        return cls(n, low_bits, bound, lows, np.packbits(row, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        return self.lows + self.highs + self.samples

    @classmethod
    def from_bytes(cls, n: int, low_bits: int, bound: int, data: memoryview) -> tuple[EliasFano, int]:
        a, b, c = cls.sizes(n, low_bits, bound)
        return cls(n, low_bits, bound, bytes(data[:a]), bytes(data[a:a + b]), bytes(data[a + b:a + b + c])), a + b + c

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.lows[first // 8:(last + 7) // 8], "little") >> (first % 8)
        return word & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from its sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = struct.unpack_from("<I", self.samples, 4 * (i // SAMPLE))[0], i % SAMPLE
        byte, bits = place // 8, self.highs[place // 8] >> (place % 8) << (place % 8)
        while (ones := bits.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            bits = self.highs[byte]
        for _ in range(left):
            bits &= bits - 1
        return (8 * byte + (bits & -bits).bit_length() - 1 - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high.astype(np.int64) << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def shard_bytes(partition: int, shard: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    n, nulls = len(doc_ids), sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(np.array(lengths, dtype=np.int64)), len(ids) // width)
    names = EliasFano.of(known - base, int(known[-1]) - base if len(known) else 0)
    head = HEADER.pack(partition, shard, width, n, nulls, len(ids) // width, base, ends.low_bits, ends.bound, names.low_bits, names.bound)
    return MARK + head + ends.to_bytes() + names.to_bytes() + ids + b"\n"


class Shard:
    """One file's content; ``offsets(i)`` is random access, ``documents()`` reads it through."""

    def __init__(self, content: bytes):
        if content[:8] != MARK or content[-1:] != b"\n":
            raise ValueError("not a whole token shard")
        (self.partition, self.number, self.width, self.n, self.nulls, self.n_ids, self.base, l1, u1, l2, u2) = HEADER.unpack_from(content, 8)
        view, at = memoryview(content), 8 + HEADER.size
        self.ends, used = EliasFano.from_bytes(self.n, l1, u1, view[at:])
        self.names, more = EliasFano.from_bytes(self.n - self.nulls, l2, u2, view[at + used:])
        at += used + more
        if len(content) != at + self.n_ids * self.width + 1:
            raise ValueError("token shard is cut off")
        self.ids = np.frombuffer(content, f"<u{self.width}", self.n_ids, at)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the shard, ids) of each document."""
        start, names = 0, [None] * self.nulls + (self.names.all() + self.base).tolist()
        for name, end in zip(names, self.ends.all().tolist()):
            yield name, start, self.ids[start:end]
            start = end


class WordTokenizer:
    """Ids of whole texts as bytes, through a cache of words that is emptied when full.

    A to Z are put in lower case before the look-up, as the tokenizer would; not so in a text that may hold the name of a
    special token, which has a case.
    """

    def __init__(self, path: str, width: int, most_words: int = 1_500_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.width, self.most, self.longest = f"<u{width}", width, most_words, longest
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes], together: int = 1000) -> dict[bytes, bytes]:
        """Ids of new words; the shorter ones are kept, the longer ones returned."""
        own = {}
        for at in range(0, len(words), together):
            part = words[at:at + together]
            coded = self.tokenizer.encode([w.decode("utf-8", "surrogatepass") for w in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, dtype=self.kind).tobytes()
            ends = (self.width * np.searchsorted(np.array(coded.word_ids, dtype=np.int64), np.arange(1, len(part) + 1))).tolist()
            start = 0
            for word, end in zip(part, ends):
                (self.known if len(word) <= self.longest else own)[word] = ids[start:end]
                start = end
        return own

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        get, out, open_texts, new = self.known.get, [], [], set()
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            words = (data if b"<|" in data else data.lower()).split()
            ids = list(map(get, words))
            if None in ids:
                new.update([w for w, i in zip(words, ids) if i is None])
                open_texts.append((len(out), words))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            own, known = self.learn(list(new)), self.known
            for at, words in open_texts:
                out[at] = b"".join([own[w] if w in own else known[w] for w in words] if own else map(known.__getitem__, words))
        return out


_SHARED: dict[tuple[str, int], WordTokenizer] = {}


def worker_tokenizer(path: str, width: int) -> WordTokenizer:
    """The tokenizer of this Python worker, which Spark uses for one task after the other: what it has cached serves them all."""
    if (path, width) not in _SHARED:
        _SHARED[path, width] = WordTokenizer(path, width)
    return _SHARED[path, width]


def _in_parts(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together."""
    part, total = [], 0
    for text in texts:
        part.append(text)
        total += len(text)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def write_shards(docs: DataFrame, path: str, tokenizer: str, width: int = 2, shard_ids: int = 2_000_000, end_id: int = END_ID) -> None:
    """Writes the shards of ``docs`` (doc_id, text). A shard is closed at ``shard_ids`` ids or more; a document is never split."""
    small_batches(docs.sparkSession)
    slim = docs.select(col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def shards(batches):
        code, end = worker_tokenizer(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        partition, number = TaskContext.get().partitionId(), 0
        names, lengths, parts, total = [], [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([shard_bytes(partition, number, names, lengths, b"".join(parts), width)[:-1]], pa.large_binary() if total * width > 2**30 else pa.binary())], ["content"])
        for batch in batches:
            coded = (ids for part in _in_parts(batch.column(1).to_pylist()) for ids in code(part))
            for name, ids in zip(batch.column(0).to_pylist(), coded):
                ids += end
                names.append(name)
                lengths.append(len(ids) // width)
                parts.append(ids)
                total += len(ids) // width
                if total >= shard_ids:
                    yield out()
                    number, names, lengths, parts, total = number + 1, [], [], [], 0
        if names:
            yield out()

    rows = ordered.mapInArrow(shards, "content binary").select(F.col("content").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, nth, doc_id, local_start, n_tokens, ids_crc32) of each document, stored."""
    small_batches(spark, 2)

    def documents(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                rows = [(name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for name, start, ids in shard.documents()]
                names, starts, counts, sums = (list(x) for x in zip(*rows))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.partition] * n, pa.int64()), pa.array([shard.number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(names, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "shard", "nth", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    out = stored(files.mapInArrow(documents, "part long, shard long, nth long, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "shard-documents")
    small_batches(spark)
    return out


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before. Totals are one row a shard; sums over all partitions have one row a partition."""
    shards = stored(rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n")), "shard-totals")
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = shards.withColumn("inside", F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n"))
    bases = stored(inside.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base")), "shard-bases")
    return rows.join(bases, ["part", "shard"]).withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards to the shared folder, reads them back, and gives (doc_id, start, n_tokens, ids_crc32) of each document."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-shards")
    write_shards(docs, path, tokenizer or default_tokenizer())
    return with_starts(read_shards(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
