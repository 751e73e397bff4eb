import random
import zlib

import numpy as np

from scorelake.llm import byte_cnn as B

WORDS = {"en": "the and with from this that have were which their would about", "de": "und der nicht eine auch werden über für mit sich haben wäre", "fr": "les des une dans avec pour qui été être vous même où"}


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k].split()) for _ in range(rng.randint(3, 80))), k, "s", 1) for i, k in ((i, list(WORDS)[i % 3]) for i in range(n))]


def test_held_out_accuracy(spark, docs_of):
    data = rows(600)
    got = B.language_query(docs_of(data)).collect()
    truth = {r[0]: r[2] for r in data}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (8, 32)).astype(np.uint8), rng.integers(0, 3, 8)
    model = B.ByteCNN(["a", "b", "c"], filters=4, window=32)
    loss = lambda m: -np.log(m.softmax(m.pooled(x.astype(np.intp)))[np.arange(8), y]).mean()
    before = loss(model)
    model.fit(x, y, epochs=300, batch=8, rate=0.01)
    assert loss(model) < before / 3


def test_windows_cover_whole_texts():
    model = B.ByteCNN(["a", "b"], filters=4, window=16)
    texts = [b"abc" * 20, b"", b"x" * 16, b"y" * 17]
    got = model.probabilities(texts, together=2)
    for t, row in zip(texts, got):
        parts = [t[i:i + 16] for i in range(0, len(t), 16)]
        windows = np.array([list(p.ljust(16, b"\0")) for p in parts], dtype=np.intp).reshape(-1, 16)
        want = sum(model.softmax(model.pooled(windows[i:i + 1]))[0] * len(p) for i, p in enumerate(parts))
        assert np.allclose(row, want / want.sum() if len(t) else 0)


def test_odd_rows(spark, docs_of, odd_rows, clashing):
    data = odd_rows + [(9, "12 34 !!", "en", "a", 1)] + rows(60, 2)
    got = B.language_query(docs_of(data)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id in (9, ) and r.lang_pred == "und":
            assert r.score == 0
    text = {r[0]: r[1] for r in odd_rows}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2) and not (text[r.doc_id] or "").strip() and r.score == 0)
    assert B.language_query(docs_of([])).count() == 0
    assert {r.lang_pred for r in B.language_query(docs_of([(1, "hello", None, "s", 1)])).collect()} == {"und"}


def test_sample_is_bounded_and_whole_below_the_bound(spark, docs_of):
    from collections import Counter

    import pytest

    df = docs_of(rows(900) + [(5000, "solo palabra", "es", "s", 1)])
    got = Counter(r.lang for r in B.training_windows(df, per_language=50).collect())
    assert got == {"en": 50, "de": 50, "fr": 50, "es": 1}
    assert sorted(map(tuple, B.training_windows(df, per_language=50).collect())) == sorted(map(tuple, B.training_windows(df.repartition(7), per_language=50).collect()))
    with pytest.raises(ValueError):
        B.train(df, most_languages=3)
