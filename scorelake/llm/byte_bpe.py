"""Byte-level BPE by ranks: encoding with a rank queue, and decoding.

A pattern splits a text into pre-tokens. One that is in the vocabulary is its id. In any other the neighbours whose joined
bytes have the least rank are merged, the leftmost of equals first, until no two neighbours join to a vocabulary entry. The neighbours
wait in a queue: a bucket for each rank holds the places (in a linked list of parts) where a pair of that rank starts, and three levels of bitmaps, 64 ways
each, tell by find-first-set which bucket is the least that is not empty. A merge changes the ranks of at most two pairs, which are put into their
buckets; what they were before stays behind and is skipped as stale when its bucket's turn comes. A merge costs the same however long the pre-token
is, and the first ranks of all pairs of bytes come from one table look-up, so work grows in proportion to the length.

All new pre-tokens of a part of a batch share one queue; links end at their borders, so each is merged as if alone. A worker keeps the ids of
short pre-tokens, and of short chunks between spaces where the pattern allows cutting there, in two bounded caches for all tasks it runs.

Ids are packed as little-endian unsigned 32-bit integers. Defined cases: null and empty texts have no ids and decode to no bytes. Repeated
rows are encoded alike, other columns stay. An empty table stays empty. An id that the vocabulary does not have, or bytes of ids that are cut off, are an error in
decoding; a vocabulary without one of the 256 single bytes is refused.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import col, small_batches, text_of


# Python's white space includes all of the tokenizer's, so what follows is cut seldom rather than wrongly.
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class RankQueue:
    """Places in buckets by rank; the least rank with a bucket comes out first."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0

    def put(self, rank: int, places: list[int]) -> None:
        """Sets a rank's bucket, which is empty."""
        self.buckets[rank] = places
        word, block = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[block] |= 1 << (word & 63)
        self.top |= 1 << block

    def add(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.put(rank, [place])
        else:
            bucket.append(place)

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank and its places in ascending order; its bucket is empty then."""
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = (block << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.mid[block] &= ~(1 << (word & 63))
            if not self.mid[block]:
                self.top &= ~(1 << block)
        places, self.buckets[rank] = self.buckets[rank], None
        places.sort()
        return rank, places


class ByteBpe:
    """Encodes and decodes with a file of ranks (base 64 of the bytes, space, rank; a line each)."""

    def __init__(self, path: str, pattern: str, cuts: bool = False, most: int = 1_200_000, longest: int = 64):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.split, self.cuts = regex.compile(pattern), cuts
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = np.full((256, 256), -1, dtype=np.int32)
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0], piece[1]] = rank
        self.queue = RankQueue(max(self.pieces) + 1)
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each word, by merges alone; words are not empty."""
        data, queue, rank_of = b"".join(words), self.queue, self.ranks.get
        borders = np.cumsum([len(w) for w in words])
        raw = np.frombuffer(data, dtype=np.uint8)
        first = np.full(len(raw), -1, dtype=np.int32)
        first[:-1] = self.pairs[raw[:-1], raw[1:]]
        first[borders - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        ranks, starts = np.unique(first[order], return_index=True)
        for rank, places in zip(ranks.tolist(), np.split(order, starts[1:])):
            queue.put(rank, places.tolist())
        # A part is known by the place of its first byte: where it ends, where the part before starts, its id, the rank of the pair it starts.
        end, ids, rank_at = array("q", range(1, len(raw) + 1)), array("i", self.single[raw].tobytes()), array("i", first.tobytes())
        before, closed, dead = array("q", range(-1, len(raw) - 1)), bytearray(len(raw) + 1), bytearray(len(raw))
        before[0] = -1
        for border in borders.tolist():
            closed[border] = 1
            if border < len(raw):
                before[border] = -1
        while (taken := queue.take()) is not None:
            rank, places = taken
            for nth, at in enumerate(places):
                if rank_at[at] != rank:
                    continue
                other, least = end[at], rank
                stop = end[other]
                end[at], ids[at], dead[other], rank_at[other], rank_at[at] = stop, rank, 1, -1, -1
                if not closed[stop]:
                    before[stop] = at
                    found = rank_of(data[at:end[stop]])
                    if found is not None:
                        rank_at[at] = found
                        queue.add(found, at)
                        least = found
                previous = before[at]
                if previous >= 0:
                    found = rank_of(data[previous:stop])
                    if found is None:
                        rank_at[previous] = -1
                    else:
                        rank_at[previous] = found
                        queue.add(found, previous)
                        least = min(least, found)
                if least < rank and nth + 1 < len(places):
                    # The new pair goes first; the places that are left wait for their turn.
                    queue.put(rank, places[nth + 1:])
                    break
        alive = np.frombuffer(dead, dtype=np.uint8) == 0
        packed = np.frombuffer(ids, dtype=np.int32)[alive].astype("<u4").tobytes()
        at = 0
        for stop in (4 * np.cumsum(alive)[borders - 1]).tolist():
            yield packed[at:stop]
            at = stop

    def learn(self, new: set[str]) -> None:
        words, raw = [], []
        for word in new:
            piece = word.encode("utf-8")
            rank = self.ranks.get(piece)
            if rank is None:
                words.append(word)
                raw.append(piece)
            else:
                self.known[word] = rank.to_bytes(4, "little")
        if raw:
            self.known.update(zip(words, self.merged(raw)))

    def encode(self, texts: list[str], together: int = 1 << 20) -> Iterator[bytes]:
        """Packed ids of each text; texts of about ``together`` characters share a queue."""
        coded = self._encode_cut if self.cuts else self._encode_whole
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= together:
                yield from coded(part)
                part, size = [], 0
        yield from coded(part)

    def _cached(self, cache: dict[str, bytes], lists: list[list[str]], learn) -> list[bytes]:
        """Joined ids of lists of strings; what the cache lacks is learnt first, and long strings are forgotten again."""
        if len(cache) > self.most:
            cache.clear()
        new = set().union(*lists).difference(cache)
        if new:
            learn(new)
        out = [b"".join(map(cache.__getitem__, strings)) for strings in lists]
        for string in new:
            if len(string) > self.longest:
                del cache[string]
        return out

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        if self.split.groups:
            return self._cached(self.known, [[m.group() for m in self.split.finditer(t)] for t in texts], self.learn)
        return self._cached(self.known, list(map(self.split.findall, texts)), self.learn)

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """Texts in chunks, each but the first without the space that it starts with: a look-up a chunk."""
        heads, lists = [], []
        for text in texts:
            if _SPACE_AFTER_SPACE.search(text):
                head, *chunks = _CUT.split(text)
                chunks = [c[1:] for c in chunks]
            else:
                head, *chunks = text.split(" ")
            heads.append(head)
            lists.append(chunks)

        def learn(new: set[str]) -> None:
            keys = list(new)
            for at in range(0, len(keys), 1 << 16):
                some = keys[at:at + (1 << 16)]
                self.spaced.update(zip(some, self._encode_whole([" " + k for k in some])))

        rest = self._cached(self.spaced, lists, learn)
        return [a + b for a, b in zip(self._encode_whole(heads), rest)]

    def decode(self, ids: bytes) -> bytes:
        if len(ids) % 4:
            raise ValueError("packed ids are cut off")
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SHARED: dict[tuple[str, str, bool], ByteBpe] = {}


def worker_bpe(path: str, pattern: str, cuts: bool = False) -> ByteBpe:
    """This Python worker's coder, whose caches serve all tasks that Spark gives it."""
    if (path, pattern, cuts) not in _SHARED:
        _SHARED[path, pattern, cuts] = ByteBpe(path, pattern, cuts)
    return _SHARED[path, pattern, cuts]


def encoded(text: Column, path: str, pattern: str, cuts: bool = False) -> Column:
    """Packed ids of a text column. ``cuts`` tells that no match of the pattern has a space behind another kind of character and
    none looks back, so that texts can be cut before every space that follows no white space; whole chunks are then looked up."""
    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(list(worker_bpe(path, pattern, cuts).encode([t or "" for t in texts])), dtype=object)

    return ids(text)


def decoded(ids: Column, path: str, pattern: str, cuts: bool = False) -> Column:
    """The bytes that packed ids stand for; null stays null."""
    @F.pandas_udf("binary")
    def raw(packed: pd.Series) -> pd.Series:
        coder = worker_bpe(path, pattern, cuts)
        return pd.Series([None if p is None else coder.decode(p) for p in packed], dtype=object)

    return raw(ids)


def round_trip(text: Column, path: str, pattern: str, cuts: bool = False) -> Column:
    """Struct of a text's packed ids (``ids``) and of the bytes they decode to (``raw``), in one pass: a column that calls one function on the other's result would encode twice."""
    @F.pandas_udf("ids binary, raw binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        coder = worker_bpe(path, pattern, cuts)
        ids = list(coder.encode([t or "" for t in texts]))
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "raw": pd.Series(map(coder.decode, ids), dtype=object)})

    return both(text)


def bpe_query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the packed ids and of what they decode to."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    coded = round_trip(text_of(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True)
    both = docs.select(col("doc_id").cast("long").alias("doc_id"), coded.alias("coded")).select("doc_id", "coded.*")
    return both.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"))
