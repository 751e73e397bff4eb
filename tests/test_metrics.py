"""Metric rules on exact cases, score cards and regression."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelake.operators import metrics as M
from scorelake.operators import scorecards as C
from scorelake.spec import PRESETS, MetricRule, discover_tasks, parse_step_models, resolve_rules, task


def score(spark, rule, parsed, sample, parsed_ddl, sample_ddl):
    df = spark.createDataFrame([(parsed, sample)], f"parsed struct<{parsed_ddl}>, sample struct<{sample_ddl}>")
    named = M.metric_columns(df.schema, [rule])
    return df.select(*[c.alias(n) for n, c in named]).first().asDict()


def rule(kind, name=None, **options):
    return MetricRule(kind, name, options)


PAIR = {"pred_field": "v", "label_field": "v"}


@pytest.mark.parametrize("r, parsed, sample, pd, sd, want", [
    (rule("exact_match", "acc", **PAIR), ("positive",), (" Positive ",), "v:string", "v:string", {"acc": 1.0}),
    (rule("exact_match", "acc", **PAIR, normalize=False), ("positive",), ("Positive",), "v:string", "v:string", {"acc": 0.0}),
    (rule("exact_match", "acc", **PAIR), None, (None,), "v:string", "v:string", {"acc": 1.0}),
    (rule("exact_match", "acc", **PAIR), (1,), (1.0,), "v:int", "v:double", {"acc": 1.0}),
    (rule("exact_match", "acc", **PAIR), (1,), ("1",), "v:int", "v:string", {"acc": 0.0}),
    (rule("exact_match", None, pred_field="v", label_field="none"), ("x",), ("y",), "v:string", "v:string", {"v_exact_match": 0.0}),
    (rule("numeric_error", "i", **PAIR, tolerance=1), (3,), (2.0,), "v:int", "v:double", {"i_mae": 1.0, "i_within_tol": 1.0}),
    (rule("numeric_error", "i", **PAIR, tolerance=1), (1,), (None,), "v:int", "v:double", {"i_mae": None, "i_within_tol": 0.0}),
    (rule("numeric_error", "i", **PAIR), ("2.5",), (2.0,), "v:string", "v:double", {"i_mae": 0.5}),
    (rule("list_overlap", "k", **PAIR), (["ai", "earnings", "macro"],), (["AI", "Earnings", "Guidance"],), "v:array<string>", "v:array<string>",
     {"k_precision": 0.6667, "k_recall": 0.6667, "k_f1": 0.6667}),
    (rule("list_overlap", "k", **PAIR), ([],), ([],), "v:array<string>", "v:array<string>", {"k_precision": 1.0, "k_recall": 1.0, "k_f1": 1.0}),
    (rule("list_overlap", "k", **PAIR), None, (["a"],), "v:array<string>", "v:array<string>", {"k_precision": 0.0, "k_recall": 0.0, "k_f1": 0.0}),
    (rule("custom_ratio", "r", numerator_field="v", denominator_fixed=100), (-40,), ("",), "v:int", "x:string", {"r": 0.4}),
    (rule("custom_ratio", "r", numerator_field="v", denominator_sample_field="x"), (3,), ([1, 2],), "v:int", "x:array<int>", {"r": 1.5}),
    (rule("custom_ratio", "r", numerator_field="v", denominator_sample_field="x"), (3,), ([],), "v:int", "x:array<int>", {"r": 3.0}),
    (rule("custom_ratio", "r", numerator_field="v", denominator_sample_field="x"), ("a",), (0.5,), "v:string", "x:double", {"r": 0.0}),
    (rule("field_completeness", fields=["a", "b", "c"]), (" ", [], 0), ("",), "a:string,b:array<int>,c:int", "x:string", {"field_completeness": 0.3333}),
    (rule("field_completeness", fields=["a"]), None, ("",), "a:string", "x:string", {"field_completeness": 0.0}),
])
def test_rules(spark, r, parsed, sample, pd, sd, want):
    assert score(spark, r, parsed, sample, pd, sd) == want


REASON = "final_answer:string,steps:array<struct<text:string>>,claims:array<struct<text:string,evidence:array<string>>>"


def test_reasoning_and_evidence(spark):
    parsed = ("positive", [("Overall Positive outlook",)], [("revenue up", ["n1", "n2"]), ("risk", ["n3"])])
    r = rule("reasoning_consistency", "reasoning", final_answer_field="final_answer", support_fields=["steps", "claims"])
    assert score(spark, r, parsed, (["n1", "n3", "n4"],), REASON, "gt:array<string>") == {"reasoning_consistency": 1.0, "reasoning_support_coverage": 0.3333}
    e = rule("claim_evidence_overlap", "evidence", label_field="gt")
    assert score(spark, e, parsed, (["n1", "n3", "n4"],), REASON, "gt:array<string>") == {
        "evidence_precision": 0.6667, "evidence_recall": 0.6667, "evidence_f1": 0.6667}
    assert score(spark, r, ("negative", [("it is positive",)], None), (None,), REASON, "gt:array<string>") == {
        "reasoning_consistency": 0.0, "reasoning_support_coverage": 0.0}


def test_evidence_over_variant_claims(spark):
    df = spark.sql("""SELECT named_struct('claims', try_variant_get(parse_json('[{"evidence": ["N1", {"id": "n2"}]}, "n3", 5]'), '$', 'array<variant>')) parsed,
                      named_struct('gt', array('n1', 'n3', 'n4')) sample""")
    named = M.metric_columns(df.schema, [rule("claim_evidence_overlap", "e", label_field="gt")])
    assert df.select(*[c.alias(n) for n, c in named]).first().asDict() == {"e_precision": 0.6667, "e_recall": 0.6667, "e_f1": 0.6667}


def test_rouge_against_plain_counting(spark):
    import re

    pairs = [("The cat sat, the cat", "the cat ran"), ("", "x"), ("a b", "c d"), (None, "a"), ("é ü", "é"), ("A-a a1", "a a a1 b"), ("x " * 5000, "x y " * 3000)]
    df = spark.createDataFrame(pairs, "h string, r string").select(M.rouge1(F.col("h"), F.col("r")).alias("f"))
    def expect(h, r):
        a, b = (Counter(re.findall("[a-z0-9]+", (x or "").lower())) for x in (h, r))
        o = (a & b).total()
        return round(2 * o / (a.total() + b.total()), 4) if o else 0.0
    assert [r.f for r in df.collect()] == [pytest.approx(expect(h, r), abs=1e-4) for h, r in pairs]


def test_unknown_metric_types_add_nothing_and_are_listed(spark):
    from scorelake.operators.checks import rule_table, unknown_metric_types

    df = spark.createDataFrame([(("a",), ("a",))], "parsed struct<v:string>, sample struct<v:string>")
    assert M.metric_columns(df.schema, [rule("bleu", "b")]) == []
    rules = rule_table(spark, extra={"mine": (rule("bleu", "b"),)})
    assert [(r.owner, r.metric_type) for r in unknown_metric_types(rules, M.known_metric_types()).collect()] == [("mine", "bleu")]


CARDS = [
    ([("choice_acc", 1.0)], "choice", ("exact_match", 1.0, True)),
    ([("value_mae", 0.005), ("value_within_tol", 1.0)], "number", ("within_tol", 1.0, True)),
    ([("value_mae", 5.0), ("value_within_tol", 0.0)], "number", ("within_tol", 0.0, False)),
    ([("custom_metric", 0.9), ("other", 0.5)], "unknown", ("custom_metric", 0.9, False)),
    ([], "choice", ("exact_match", 0.0, False)),
    ([], "unknown", ("", 0.0, False)),
    ([("rouge1", None)], "text", ("rouge1", 0.0, False)),
    ([("stuff1", 1.0), ("a_f1", 0.6), ("b_f1", 0.1)], "list", ("f1", 0.6, True)),
    ([("rouge1", 0.3)], "text", ("rouge1", 0.3, True)),
]


def test_score_cards(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(CARDS)], "i int, raw_scores array<struct<name:string,value:double>>, answer_type string")
    got = C.score_cards(df).orderBy("i").collect()
    assert [(r.primary_metric, r.primary_score, r.passed) for r in got] == [c[2] for c in CARDS]


@pytest.mark.parametrize("base, cur, tol, bad", [
    (.80, .85, .02, False), (.80, .70, .02, True), (.80, .79, .02, False), (.80, .78, .02, False), (.80, .7799, .02, True), (.80, .70, .15, False), (.5, .5, .02, False),
])
def test_regression(spark, base, cur, tol, bad):
    df = spark.createDataFrame([(base, cur)], "b double, c double")
    row = C.check_regression(df, "c", "b", F.lit("f1"), tol).first()
    assert row.regressed is bad
    assert row.details == (f"REGRESSION: f1 dropped by {abs(round(cur - base, 6)):.4f} (tolerance={tol})" if bad else "OK")


def test_rule_resolution():
    own = (rule("exact_match", "mine"),)
    assert resolve_rules(None, own) == own
    assert resolve_rules("list", own) == own
    assert resolve_rules("list", ()) == PRESETS["list"].metrics
    assert resolve_rules("essay", ()) == ()
    with pytest.raises(ValueError):
        task("nope")


def test_step_models():
    assert parse_step_models("", "act") == ("act", {})
    assert parse_step_models(" m ", "act") == ("m", {})
    assert parse_step_models("a=m1, b = m2,junk", "act") == ("act", {"a": "m1", "b": "m2"})


def test_task_discovery(tmp_path):
    (tmp_path / "one.json").write_text('{"name": "one", "parse_schema": [{"field": "a"}], "metrics": [{"type": "exact_match", "name": "m"}]}')
    found = discover_tasks(tmp_path)
    assert found["one"].parse_applicable and found["one"].metrics[0].name == "m"
