import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import pitman_yor as P
from scorelake.session import shared_dir


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    follow = {w: rng.sample([f"w{i}" for i in range(60)], 6) for w in [f"w{i}" for i in range(60)]}
    rows = []
    for i in range(n):
        w, out = rng.choice(list(follow)), []
        for _ in range(rng.randint(0, 30)):
            out.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"r{rng.randint(0, 400)}"
            follow.setdefault(w, rng.sample(list(follow), 3))
        rows.append((i, " ".join(out), "en", "s", 1))
    return rows


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_counts_and_base_are_exact_and_the_model_is_better(spark, docs_of):
    rows = corpus()
    got = {r.doc_id: r for r in P.language_model_query(docs_of(rows)).collect()}
    counts = Counter(w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        r, words = got[i], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    for held in (True, False):
        mine = [r for r in got.values() if r.held_out == held]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_predictive_probabilities_are_normalised(spark, docs_of):
    """Over every context the known words and one unknown have probability one, as the rows of the model say."""
    slim = docs_of(corpus(80)).select("doc_id", "text", F.lit(True).alias("learned"))
    rows, settings, numbers, totals = P.learned_model(slim, 20, 1, 2, 500)
    model = P.predictive(rows, settings, 1).collect()
    samples = settings.sums[2:]
    unknown = np.array([settings.unknown(s) for s in samples])
    top = np.array([r.top for r in model])
    assert np.allclose(top.sum(axis=0) + unknown, 1)
    back = np.stack([settings.back_off(s) for s in samples], axis=1)
    for c in range(1, len(settings.customers)):
        if not settings.customers[c]:
            continue
        seen = [dict(zip(r.ctxs, r.probs)).get(c) for r in model]
        total = sum(p if p is not None else float((back[c] * t).mean()) for p, t in zip(seen, top)) + float((back[c] * unknown).mean())
        assert total == pytest.approx(1)


def test_scores_match_the_model_rows(spark, docs_of):
    data = corpus(60, 4)
    slim = docs_of(data).select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("learned"))
    rows, settings, numbers, totals = P.learned_model(slim, 15, 1, 2, 300)
    model = {bytes(r.word): r for r in P.predictive(rows, settings, 1).collect()}
    samples = settings.sums[2:]
    back, unknown = np.stack([settings.back_off(s) for s in samples], axis=1), np.array([settings.unknown(s) for s in samples])
    out, _ = P.scored(slim, 15, 1, 2, 300)
    got = {r.doc_id: r.score for r in out.collect()}
    for i, t, *_ in data:
        total, ctx = 0.0, numbers[P.END]
        for w in tokens(t):
            r = model.get(w)
            p = dict(zip(r.ctxs, r.probs)).get(ctx) if r else None
            total += math.log10(p if p is not None else float((back[ctx] * (np.array(r.top) if r else unknown)).mean()))
            ctx = numbers.get(w, 0)
        assert got[i] == pytest.approx(total)


def test_every_context_has_a_restaurant(spark, docs_of):
    """The whole model against its rows: a restaurant for each word that another one follows, probabilities of one, and the sums of every document."""
    data = corpus(60, 5)
    slim = docs_of(data).select("doc_id", "text", (F.col("doc_id") % 3 > 0).alias("learned"))
    pairs, contexts, words, settings, totals = P.whole_model(slim, 1, 2, 300)
    follow, counts = Counter(), Counter()
    for i, t, *_ in data:
        for a, b in zip([P.END, *tokens(t)], tokens(t)):
            follow[a, b] += i % 3 > 0
            counts[b] += i % 3 > 0
    got = {(bytes(r.ctx), bytes(r.word)): r for r in pairs.collect()}
    assert {k: r.n for k, r in got.items()} == dict(follow) and all(min(r.n, 1) <= r.t <= r.n for r in got.values())
    assert any(r.t > 1 for r in got.values()) and {r.t for r in got.values() if r.n == 1} == {1.0}
    ctx, word = {bytes(r.ctx): r for r in contexts.collect()}, {bytes(r.word): r for r in words.collect()}
    assert {k: r.n for k, r in word.items()} == dict(counts) and sum(r.c > 0 for r in ctx.values()) > 100
    probs = {(bytes(r.ctx), bytes(r.word)): r.p for r in P.pair_probabilities(pairs, contexts, words, settings, 2).collect()}
    unknown = [settings.unknown(s) for s in settings.sums[2:]]
    for c, r in ctx.items():
        back = (r.back_0, r.back_1)
        other = sum(np.dot(back, (w.prob_0, w.prob_1)) / 2 for k, w in word.items() if counts[k] and (c, k) not in probs)
        assert sum(p for (a, b), p in probs.items() if a == c and counts[b]) + other + np.dot(back, unknown) / 2 == pytest.approx(1)
    scores = {r.doc_id: r.score for r in P.scored(slim, None, 1, 2, 300)[0].collect()}
    for i, t, *_ in data:
        assert scores[i] == pytest.approx(sum(math.log10(probs[p]) for p in zip([P.END, *tokens(t)], tokens(t))))


def test_the_query_learns_what_follows_rare_words(spark, docs_of):
    """400 contexts, each always followed by its own word: a model with few restaurants could not tell them from shuffled ones."""
    rng = random.Random(6)
    pair = lambda k, other: f"a{k} b{other} "
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:200]
    rows = [(i, "".join(pair(k, k) for k in rng.sample(range(400), 40)), "en", "s", 1) for i in learned]
    rows += [(held[0], "".join(pair(k, k) for k in range(400)), "en", "s", 1), (held[1], "".join(pair(k, (k + 1) % 400) for k in range(400)), "en", "s", 1)]
    got = {r.doc_id: r for r in P.language_model_query(docs_of(rows)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score) and got[held[0]].score > got[held[1]].score + 400


def test_what_is_kept_does_not_grow_with_the_sweeps(spark, docs_of):
    """A sweep takes the folders of the one before the last; before, each left three tables more."""
    slim = docs_of(corpus(30, 7)).select("doc_id", "text", F.lit(True).alias("learned"))
    base, kept = Path(shared_dir(spark, "none").removeprefix("file://")).parent, []
    for samples in (1, 4):
        had = len([*base.rglob("_SUCCESS")])
        assert P.scored(slim, None, 1, samples, 300)[0].count() == 30
        kept.append(len([*base.rglob("_SUCCESS")]) - had)
    assert kept[0] == kept[1] > 0


def test_places_do_not_change_scores(spark, docs_of):
    """One place, and many with contexts that are spread over them."""
    slim = docs_of(corpus(60, 8)).select("doc_id", "text", (F.col("doc_id") % 3 > 0).alias("learned"))
    one, many = ({r.doc_id: r for r in P.packed_scores(slim, 1, 2, 300, least=least)[0].collect()} for least in (10**9, 30))
    assert len(one) == 60 and all(many[i].score == pytest.approx(r.score) and (many[i].n_tokens, many[i].n_known) == (r.n_tokens, r.n_known) for i, r in one.items())


def test_packed_arrays():
    for values, kind in (([], "u4"), ([0, 1, 2**40, -5], "i8"), ([2**64 - 1], "u8"), ([7, 0, 255], "u1")):
        assert P.unpack(P.pack(values, kind)).tolist() == values
    for texts in ([], [b"", b"a", "\u00e9\u4e00".encode()]):
        assert P._texts(*P._pack_texts(texts)).to_pylist() == texts


def test_seating(spark):
    counts = np.array([0, 1, 2, 64, 65, 5000, 10**7])
    ones = np.ones(len(counts))
    t = P.seated(counts, ones, 0.5, 0.1 * ones, np.arange(len(counts), dtype=np.uint64), 1)
    assert t[0] == 0 and t[1] == 1 and (t <= np.maximum(counts, 0)).all() and (t >= np.minimum(counts, 1)).all()
    assert (t == P.seated(counts, ones, 0.5, 0.1 * ones, np.arange(len(counts), dtype=np.uint64), 1)).all()
    many = P.seated(np.full(4000, 200), np.ones(4000), 0.5, np.full(4000, 0.2), np.arange(4000, dtype=np.uint64), 2)
    rng, plain = np.random.default_rng(1), []
    for _ in range(1000):
        k = 1
        for i in range(1, 200):
            a = (1 + 0.5 * k) * 0.2
            k += rng.random() < a / (a + i - 0.5 * k)
        plain.append(k)
    assert abs(many.mean() - np.mean(plain)) < 0.5


def test_odd_rows(spark, docs_of, odd_rows):
    got = P.language_model_query(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows) and sum(r.doc_id is None for r in got) == 1 and all(np.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert P.language_model_query(docs_of([])).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = P.language_model_query(docs_of([(alone, "a b", "en", "s", 1)])).first()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)
