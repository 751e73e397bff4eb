import math
import random

import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from scorelake.llm import source_mixing as M


def shares_of(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(t / total,) for t in tokens], "share double"), [t / total for t in tokens]


def weights(p, a):
    w = [x**a for x in p]
    return [x / sum(w) for x in w]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


@pytest.mark.parametrize("target", [0.0, 0.3, 0.9, 1.0])
def test_exponent_meets_the_entropy(spark, target):
    df, p = shares_of(spark, [5000, 900, 300, 40, 7])
    a = M.mixing_exponent(df, target, most_repeats=1e9)
    wanted = entropy(p) + target * (math.log(5) - entropy(p))
    assert entropy(weights(p, a)) >= wanted - 1e-9 and (target == 0 or entropy(weights(p, a)) <= wanted + 1e-6)


def test_repeat_limit_wins(spark):
    df, p = shares_of(spark, [5000, 900, 300, 40, 7])
    a = M.mixing_exponent(df, 1.0, most_repeats=3.0)
    most = max(w / x for w, x in zip(weights(p, a), p))
    assert 2.999 <= most <= 3.0 + 1e-6
    assert M.mixing_exponent(df, 1.0, most_repeats=0.5) == 1.0
    assert M.mixing_exponent(shares_of(spark, [5])[0]) == 1.0 and M.mixing_exponent(spark.createDataFrame([], "share double")) == 1.0


def corpus():
    rng = random.Random(6)
    return [(i, prose(rng, rng.randint(1, 60)), "en", "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else None), 1) for i in range(1500)]


def test_draws_follow_plan_in_brute_force(spark, docs_of):
    rows = corpus()
    docs = docs_of(rows)
    tokens = {r[0]: len(r[1].split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    place = {r.doc_id: r.at for r in docs.select("doc_id", M.place(F.col("doc_id"), 17).alias("at")).collect()}
    w = {r.source: r for r in M.source_weights(M.token_rows(docs, 17)).collect()}
    got = sorted(((r.doc_id, r["pass"]) for r in M.mixing_query(docs).collect()))
    assert sum(x.weight for x in w.values()) == pytest.approx(1) and len(w) == 3
    want = []
    for s, info in w.items():
        mine = [d for d in tokens if source[d] == s]
        number, used = 0, 0
        while used < info.budget:
            blocks = {}
            for d in mine:
                blocks.setdefault(place[d] >> 55, []).append(d)
            order = [r.b for r in spark.createDataFrame([(b, number) for b in blocks], "b int, p int").orderBy(F.xxhash64(F.lit(17), "p", "b"), "b").collect()]
            for b in order:
                n = sum(tokens[d] for d in blocks[b])
                if used + n > info.budget:
                    for d in sorted(blocks[b], key=lambda d: place[d]):
                        if used + tokens[d] > info.budget:
                            break
                        used += tokens[d]
                        want.append((d, number))
                    used = info.budget
                    break
                used += n
                want += [(d, number) for d in blocks[b]]
            number += 1
    assert got == sorted(want)


def test_budgets_are_met_closely(spark, docs_of):
    docs = docs_of(corpus())
    for r in M.mixing_query(docs).groupBy("source", "source_weight").agg(F.sum("n_tokens").alias("n")).collect():
        aim = r.source_weight * sum(len(x[1].split()) for x in corpus())
        assert aim - 61 <= r.n <= aim


def test_mix_key_interleaves(spark, docs_of):
    rows = M.mixing_query(docs_of(corpus())).orderBy("mix_key").collect()
    half = [r for r in rows if r.mix_key < 0.5]
    for s in ("big", "mid", None):
        whole = sum(r.n_tokens for r in rows if r.source == s)
        assert abs(sum(r.n_tokens for r in half if r.source == s) / whole - 0.5) < 0.1


def test_odd_rows(spark, docs_of, odd_rows, clashing):
    df = clashing(docs_of(odd_rows))
    out = M.mixed(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {r[0] for r in odd_rows}
    assert M.mixed(docs_of([])).count() == 0 and M.mixing_query(docs_of([])).count() == 0


def test_rows_without_an_id_are_dealt_by_their_texts(docs_of):
    """A source of them alone is drawn up to its budget like any other."""
    rng = random.Random(5)
    rows = [(None, prose(rng, 100), "en", "a", 1) for _ in range(50)] + [(i, prose(rng, 100), "en", "b", 1) for i in range(20)]
    out = M.mixing_query(docs_of(rows)).groupBy("source", "source_weight").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.source: 7000 * r.source_weight - 101 <= r.n <= 7000 * r.source_weight for r in out} == {"a": True, "b": True}
    assert M.mixed(docs_of(rows)).where("doc_id is null").count() > 20
