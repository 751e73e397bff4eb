import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import prose
from pyspark.sql import functions as F

from scorelake.llm.byte_bpe import ByteBpe, RankQueue, bpe_query, decoded, encoded

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return ByteBpe(PATH, PATTERN, True)


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_library(plain, text):
    return np.array(plain.encode_ordinary(text), dtype="<u4").tobytes()


def test_queue_gives_the_least_rank_with_its_places_in_order():
    rng, queue, held = random.Random(5), RankQueue(300_000), {}
    for _ in range(3000):
        if held and rng.random() < 0.5:
            least = min(held)
            assert queue.take() == (least, sorted(held.pop(least)))
        else:
            rank, place = rng.choice((0, 63, 64, 4095, 4096, 299_999, rng.randrange(300_000))), rng.randrange(1000)
            queue.add(rank, place)
            held.setdefault(rank, []).append(place)
    while held:
        least = min(held)
        assert queue.take() == (least, sorted(held.pop(least)))
    assert queue.take() is None


def test_as_the_library(coder, plain):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("abcdeaéßñ漢字 11!!\n   '\t  \x1c\x85s😀") for _ in range(rng.randint(0, 60)))
        assert next(coder.encode([text])) == by_library(plain, text), text


def test_merges_of_any_order_against_repeated_least_pairs():
    """A vocabulary whose joins are not in training order: new pairs can rank below those that wait."""
    rng = random.Random(9)
    for _ in range(150):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(12)}
        order = rng.sample(sorted(pieces), len(pieces))
        ranks = {bytes([b]): b for b in range(256)} | {p: 256 + n for n, p in enumerate(order)}
        own = ByteBpe.__new__(ByteBpe)
        own.ranks, own.pairs, own.queue = ranks, np.full((256, 256), -1, dtype=np.int32), RankQueue(300)
        own.single = np.arange(256, dtype=np.int32)
        for p, r in ranks.items():
            if len(p) == 2:
                own.pairs[p[0], p[1]] = r
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(10)]
        for word, ids in zip(words, own.merged(words)):
            parts = [word[i:i + 1] for i in range(len(word))]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                at = min(found)[1]
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            assert np.frombuffer(ids, "<u4").tolist() == [ranks[p] for p in parts], (word, order)


@pytest.mark.parametrize("text", ["a" * 70_001, "ab" * 30_000, "=" * 9_999, " " * 5_001, " \n" * 3_000 + "a", "é" * 3_001, "Zoë's 1234567 x\x00y"])
def test_long_pre_tokens(coder, plain, text):
    ids = next(coder.encode([text]))
    assert ids == by_library(plain, text) and coder.decode(ids) == text.encode()


def test_cutting_changes_nothing_and_caches_may_be_small(plain):
    rng = random.Random(2)
    texts = [prose(rng, 400, "aeéiostn'., \n") for _ in range(30)] + ["x" * 500 + " " + "y" * 90 + " z"] * 2
    whole = list(ByteBpe(PATH, PATTERN).encode(texts))
    small = ByteBpe(PATH, PATTERN, True, most=50, longest=4)
    assert whole == list(small.encode(texts, together=1000)) == list(small.encode(texts)) == [by_library(plain, t) for t in texts]
    assert max(map(len, [*small.known, *small.spaced])) <= 4


def test_pattern_with_groups():
    assert list(ByteBpe(PATH, r"(a)|(b+)|[^ab]").encode(["abbc a"])) == list(ByteBpe(PATH, r"a|b+|[^ab]").encode(["abbc a"]))


def test_query(spark, docs_of, odd_rows, clashing, plain):
    docs = clashing(docs_of(odd_rows))
    out = bpe_query(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(out.dtypes)["n_tokens"] == "bigint"
    want = []
    for row in odd_rows:
        text = row[1] or ""
        ids = by_library(plain, text)
        want.append((row[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert bpe_query(docs_of([])).count() == 0


def test_columns_round_trip_and_bad_ids(spark):
    df = spark.createDataFrame([(1, "some wörds"), (2, None)], "k long, text string")
    rows = df.select("k", decoded(encoded(F.col("text"), PATH, PATTERN), PATH, PATTERN).cast("string").alias("back")).orderBy("k").collect()
    assert [r["back"] for r in rows] == ["some wörds", ""]
    assert df.select(decoded(F.lit(None).cast("binary"), PATH, PATTERN).alias("x")).first()["x"] is None
    coder = ByteBpe(PATH, PATTERN)
    with pytest.raises(ValueError):
        coder.decode(b"\x01\x00\x00")
    with pytest.raises(KeyError):
        coder.decode(b"\xff\xff\xff\x7f")


def test_vocabulary_without_a_byte_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(255)))
    with pytest.raises(ValueError):
        ByteBpe(str(path), PATTERN)
