import random
import re

import pytest
from conftest_llm import plan_of, prose
from pyspark.sql import functions as F

from scorelake.llm import common
from scorelake.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark, docs_of, odd_rows):
    rng = random.Random(1)
    texts = ["a b c d e a b c d e f", "x " * 30, "one\none\n\none two#|", "a b c d e f g a b c d e f g h", "été # $\x0bq"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) + "\n" * rng.randint(0, 2) for _ in range(60)]
    rows = [r for r in odd_rows if r[0] != 4] + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = Q.measured(docs_of(rows)).select("text", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text), r.text


@pytest.mark.parametrize("value", [0, 1, 31, 32, 33, 63, 64, 65, 127, 128, 1000, 123456789])
def test_buckets_hold_their_values(spark, value):
    row = spark.range(1).select(Q.bucket_of(F.lit(value).cast("long")).alias("b"), Q.bucket_of(F.lit(value + 1).cast("long")).alias("c"))
    row = row.select("b", "c", Q.bucket_floor(F.col("b")).alias("lo"), Q.bucket_floor(F.col("b") + 1).alias("hi")).first()
    assert row.lo <= value < row.hi and row.b <= row.c and row.hi - row.lo <= max(1, value / 31)


def test_sketches_merge(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30), "en" if i % 3 else None, f"s{i % 4}", 1) for i in range(120)]
    m = Q.measured(docs_of(rows))
    whole = {(r.measure, r.bucket): r.docs for r in Q.merged(Q.sketches(m)).collect()}
    halves = Q.sketches(m.where("doc_id < 50")).union(Q.sketches(m.where("doc_id >= 50")))
    assert whole == {(r.measure, r.bucket): r.docs for r in Q.merged(halves).collect()} and sum(whole.values()) == 120 * len(Q.RATES)


def test_filter_keeps_clean_and_drops_junk(spark, docs_of, clashing):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + ".", "en", f"s{i % 2}", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(rng, 60).split()), "en", "s0", 1) for i in range(10)]
    rows += [(2000, "few words", "en", "s0", 1)]
    out = Q.quality_stage(clashing(docs_of(rows)))
    assert out.columns == clashing(docs_of(rows)).columns
    assert {r.doc_id for r in out.collect()} == set(range(300))


def test_fences_are_counted_with_their_salts(spark, docs_of, monkeypatch):
    """Four groups are few, their 128 rows with salts are more than may be broadcast here."""
    rng = random.Random(5)
    df = docs_of([(i, prose(rng, 30), "en" if i % 2 else None, f"s{i % 4 // 2}", 1) for i in range(80)])
    want = sorted(map(tuple, Q.quality_query(df).collect()), key=str)
    monkeypatch.setattr(common, "MOST_BROADCAST", 100)
    out = Q.quality_query(df)
    assert "SortMergeJoin" in plan_of(out) and "Broadcast" not in plan_of(out)
    assert sorted(map(tuple, out.collect()), key=str) == want and len(want) == 80


def test_odd_rows_and_empty(spark, docs_of, odd_rows):
    got = [(r.doc_id, r.kept) for r in Q.quality_query(docs_of(odd_rows)).collect()]
    assert len(got) == len(odd_rows) and dict(got)[4] is True and dict(got)[1] is False and dict(got)[2] is False
    assert Q.quality_query(docs_of([])).count() == 0 and Q.quality_stage(docs_of([])).count() == 0
