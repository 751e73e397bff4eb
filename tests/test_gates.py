"""Gates, error tags, baselines as of a run, step order and claims, each against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest

from scorelake.operators import gates as G
from scorelake.operators import metrics as M
from scorelake.operators import scorecards as C
from scorelake.operators.claims import claim_support, claim_verifiability
from scorelake.spec import MetricRule


def test_every_kind_of_gate(spark):
    gates = (G.Gate("span", "a_f1|b", "range", 0.2, 0.9), G.Gate("fall", ".*_f1", "drop", tolerance=0.02), G.Gate("mae", ".*_mae", "rise", tolerance=0.5), G.Gate("soft", "b", "range", 0.0, required=False))
    rows = [("a_f1", 0.5, 0.52), ("a_f1", 0.5, 0.5201), ("a_f1", 0.1, 0.9), ("x_a_f1", 1.0, None), ("b", 0.95, None), ("b", None, 1.0), ("b", float("nan"), 1.0), ("v_mae", 3.0, 2.5), ("v_mae", 3.1, 2.5), ("v_mae", None, 2.5), ("other", 0.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, metric string, current_score double, baseline_score double")
    got = {}
    for r in G.check_gates(df, gates).collect():
        got.setdefault(r.i, []).append((r.gate, r.breach))
    got = {i: sorted(v, key=str) for i, v in got.items()}
    assert got == {i: sorted(v, key=str) for i, v in {
        0: [("span", None), ("fall", None)], 1: [("span", None), ("fall", "dropped by 0.0201 (tolerance=0.02)")], 2: [("span", "0.1000 is under 0.2"), ("fall", "dropped by 0.8000 (tolerance=0.02)")],
        3: [("fall", None)], 4: [("span", "0.9500 is over 0.9"), ("soft", None)], 5: [("span", "missing"), ("soft", None)], 6: [("span", "missing"), ("soft", None)],
        7: [("mae", None)], 8: [("mae", "rose by 0.6000 (tolerance=0.5)")], 9: [("mae", "missing")]}.items()}
    verdict = {r.i: r for r in G.gate_verdicts(G.check_gates(df, gates), ["i"]).collect()}
    assert verdict[2].breached == 2 and verdict[2].first_gate == "span" and verdict[0].passed and verdict[0].first_gate is None and 10 not in verdict
    whole = G.gate_verdicts(G.check_gates(df, gates), []).first()
    assert (whole.checked, whole.passed, whole.first_gate, whole.first_metric) == (16, False, "span", "a_f1")
    with pytest.raises(ValueError):
        G.Gate("g", "x", "sideways")


CARD = "k string, answer_type string, raw_scores array<struct<name:string,value:double>>"


def test_tags_and_their_counts(spark):
    rows = [("a", "list", [("l_precision", 0.4), ("l_recall", 0.4), ("l_f1", 0.4)]), ("a", "list", [("l_precision", 1.0), ("l_recall", 0.1), ("l_f1", 0.2)]), ("a", "choice", [("choice_acc", 1.0)]),
            ("b", "choice", [("choice_acc", None)]), ("b", "choice", []), ("b", "choice", None), ("b", "free", [("mine", 0.0)]), (None, "text", [("rouge1", 0.29)])]
    cards = C.score_cards(spark.createDataFrame(rows, CARD))
    tags = sorted(((r.k, tuple(r.error_tags)) for r in cards.collect()), key=str)
    assert tags == sorted([
        ("a", ("extra_items", "missed_items", "below_threshold")), ("a", ("missed_items", "little_overlap", "below_threshold")), ("a", ()), ("b", ("missing_score", "below_threshold")),
        ("b", ("no_score", "below_threshold")), ("b", ("no_score", "below_threshold")), ("b", ()), (None, ("little_overlap", "below_threshold"))], key=str)
    counts, pairs, size = Counter(), Counter(), Counter(k for k, _ in tags)
    for k, own in tags:
        counts.update((k, t) for t in own)
        pairs.update((k, *p) for p in itertools.combinations(sorted(own), 2))
    assert {(r.k, r.tag): (r["rows"], r.share) for r in G.tag_counts(cards, ["k"]).collect()} == {(k, t): (n, round(n / size[k], 4)) for (k, t), n in counts.items()}
    assert {(r.k, r.tag, r.other): r["rows"] for r in G.tag_pair_counts(cards, ["k"]).collect()} == pairs
    assert sum(r["rows"] for r in G.tag_counts(cards, []).collect()) == sum(counts.values())
    own = C.score_cards(spark.createDataFrame(rows, CARD), tags=(C.TagRule("zero", "mine", under=0.5),)).where("answer_type = 'free'").first()
    assert own.error_tags == ["zero"]
    assert not [r for r in C.score_cards(spark.createDataFrame(rows, CARD), tags=None).collect() if r.error_tags]


SCORE = "run_id string, run_time timestamp, task_name string, metric string, score double"


def runs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "run_id string, s long, task_name string, metric string, score double")
    return df.select("run_id", F.timestamp_seconds("s").alias("run_time"), "task_name", "metric", "score")


@pytest.mark.parametrize("apart", [False, True])
def test_baseline_as_of_a_run(spark, apart):
    rng = random.Random(4)
    make = lambda tag: [(f"{tag}{i}", rng.randrange(12), rng.choice("xy"), rng.choice(["f1", "acc"]), rng.choice([None, round(rng.random(), 3)])) for i in range(60)]
    current, base = make("c"), make("b")
    base = base if apart else current
    got = G.as_of_baseline(runs(spark, current), runs(spark, base), ["task_name"]).collect()
    want = {}
    for run, time, task, metric, score in current:
        earlier = [(t, r, s) for r, t, k, m, s in base if (k, m) == (task, metric) and t < time and s is not None]
        newest = max(earlier, default=(None, None, None))
        want[run, task, metric] = (score, newest[1], newest[2])
    assert {(r.run_id, r.task_name, r.metric): (r.current_score, r.baseline_run, r.baseline_score) for r in got} == want and len(got) == 60


def test_report_over_runs(spark):
    rows = [("r1", 1, "x", "f1", 0.8), ("r1", 1, "x", "acc", 0.5), ("r2", 2, "x", "f1", 0.7), ("r3", 3, "x", "f1", None), ("r3", 3, "x", "acc", 0.6), ("r4", 4, "x", "f1", 0.69), ("r4", 4, "y", "f1", 0.1)]
    got = {r.run_id: r for r in G.cross_run_report(G.compare_over_runs(runs(spark, rows), ["task_name"]), ["task_name"]).collect()}
    assert (got["r1"].scores, got["r1"].compared, got["r1"].worst_delta) == (2, 0, None)
    assert (got["r2"].regressed, got["r2"].worst_delta, got["r2"].worst_metric) == (1, -0.1, "f1")
    assert (got["r3"].scores, got["r3"].compared, got["r3"].improved) == (2, 2, 1)
    # The newest earlier run that has the score is r2: r3 has none.
    assert (got["r4"].compared, got["r4"].regressed, got["r4"].worst_delta, got["r4"].worst_task_name) == (1, 0, -0.01, "x")


def rising(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def test_longest_rising_run(spark):
    rng = random.Random(6)
    lists = [[], [1], [2, 2, 2], [3, 2, 1], list(range(40))] + [[rng.randrange(15) for _ in range(rng.randrange(25))] for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(lists)), "i int, v array<int>").select("i", M.longest_rising(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: rising(v) for i, v in enumerate(lists)}


@pytest.mark.parametrize("steps, chain, order, complete", [
    (["a", "b", "c"], ["A ", "b", "c"], 1.0, 1.0), (["c", "b", "a"], ["a", "b", "c"], 0.3333, 1.0), (["a", "x", "c"], ["a", "b", "c", "d"], 1.0, 0.5), (["b", "b", "c"], ["a", "b", "c"], 0.6667, 0.6667),
    ([], ["a"], 0.0, 0.0), (["a"], [], 0.0, 0.0), (None, None, 0.0, 0.0), (["a", None, " "], ["a", "a", "b"], 1.0, 0.5),
])
def test_step_order(spark, steps, chain, order, complete):
    df = spark.createDataFrame([((steps,), (chain,))], "parsed struct<steps:array<string>>, sample struct<gt_steps:array<string>>")
    row = df.select(*[c.alias(n) for n, c in M.metric_columns(df.schema, [MetricRule("reasoning_step_order")])]).first()
    assert row.asDict() == {"steps_order": order, "steps_completeness": complete}


def test_claims_against_every_pair(spark):
    rng = random.Random(8)
    words = "the a of zeta Élan x1 rare dog cat tree".split()
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randrange(40)) for _ in range(60)] + [None, "", "!!"]
    passages += passages[:9] * 3
    claims = [(i % 7, text(rng.randint(1, 4))) for i in range(120)] + [(7, None), (7, "?"), (7, "unheard"), (8, "the dog")]
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    held = lambda c: sum(plain(c) in plain(p) for p in passages) if plain(c).strip() else 0
    df = spark.createDataFrame(claims, "k int, claim string")
    ps = spark.createDataFrame([(p,) for p in passages], "text string")
    got = {r.normal: r.supporting for r in claim_support(df, ps).collect()}
    assert got == {plain(c): held(c) for _, c in claims if plain(c).strip()}
    for r in claim_verifiability(df, ps, ["k"]).collect():
        own = [held(c) for k, c in claims if k == r.k]
        assert (r.n_claims, r.n_verifiable, r.least_support) == (len(own), sum(n > 0 for n in own), min(own))
        assert math.isclose(r.sufficient_rate, sum(n > 1 for n in own) / len(own), abs_tol=5e-5)
    assert claim_verifiability(df, ps.limit(0), ["k"]).where("n_verifiable > 0").count() == 0 and claim_support(df.limit(0), ps).count() == 0
