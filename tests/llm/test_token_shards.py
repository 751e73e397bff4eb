import random
import zlib

import numpy as np
import pytest
from conftest_llm import prose

from scorelake.llm import token_shards as T
from scorelake.session import shared_dir


@pytest.mark.parametrize("n, bound", [(0, 0), (1, 0), (1, 10**12), (5, 4), (1000, 10**6), (1000, 10), (3000, 2**40)])
def test_elias_fano_round_trip(n, bound):
    rng = np.random.default_rng(n + bound % 97)
    values = np.sort(rng.integers(0, bound + 1, n))
    data = T.EliasFano.of(values, bound).to_bytes()
    low = T.EliasFano.of(values, bound).low_bits
    back, used = T.EliasFano.from_bytes(n, low, bound, memoryview(data + b"rest"))
    assert used == len(data) and (back.all() == values).all()
    assert [back.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        back.select(n)
    if n > 100:
        assert 8 * len(data) <= n * (2 + max(1, (bound // n).bit_length())) + 200 + 32 * (n // T.SAMPLE + 1)


def test_words_make_whole_texts():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(T.default_tokenizer()), T.WordTokenizer(T.default_tokenizer(), 2, most_words=50)
    rng = random.Random(1)
    pieces = ["The", "it's", "DON'T", "naïve", "é", "́x", "ΑΣ", "ΑΣ.", " ", " a", "\x0b", "\x0c", "\x1c", "\x85", "123", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b",
              "###", "'s", ".'s", "\U0001f600", "İ", "ǅ", "ﬁ", "中文", "a​b", "x" * 200, "É" * 70]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "", "\n", "\t ", "\r\n"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own([text, text])[1], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip_through_files(spark, docs_of, odd_rows, clashing):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = odd_rows + [(rng.randint(-50, 10**12), prose(rng, rng.randint(0, 40)), "en", "s", 1) for _ in range(200)]
    path = shared_dir(spark, "shards-test")
    T.write_shards(clashing(docs_of(rows)), path, T.default_tokenizer(), shard_ids=3000)
    got = T.with_starts(T.read_shards(spark, path)).orderBy("start").collect()
    whole = Tokenizer.from_file(T.default_tokenizer())
    coded = {(r[0], r[1]): whole.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    expected = sorted(((-(2**63) if d is None else d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, t), i in ((k, coded[k]) for k in [(r[0], r[1]) for r in rows]))
    assert sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).first().content
    shard = T.Shard(content)
    assert [shard.offsets(i) for i in range(shard.n)] == [(s, s + len(x)) for _, s, x in shard.documents()]
    with pytest.raises(ValueError):
        T.Shard(content[:-9] + b"\n")


def test_empty(docs_of):
    assert T.token_output(docs_of([])).count() == 0
