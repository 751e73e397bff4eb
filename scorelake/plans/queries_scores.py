"""Metrics, score cards, regression, whole runs and the extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from scorelake.functions.text import normalize_text
from scorelake.operators import aggregates as A
from scorelake.operators import gates as G
from scorelake.operators import metrics as M
from scorelake.operators import scorecards as C
from scorelake.operators.claims import claim_verifiability, sentences
from scorelake.plans import runs as RUN
from scorelake.plans.adapters import MODEL_IDS, Tables, nth
from scorelake.plans.queries_stats import _F1
from scorelake.plans.registry import query
from scorelake.session import shared_dir, stored_once
from scorelake.sources import writers as W
from scorelake.spec import MetricRule, TaskSpec, WorkflowSpec, WorkflowStep, resolve_rules


def _metrics(df, rules, key: str):
    """Metric columns side by side with the key."""
    named = M.metric_columns(df.schema, rules)
    return df.select(key, *[c.alias(n) for n, c in named])


@query("met_field_completeness", """SELECT doc_id, CASE WHEN doc_id%13=0 THEN 0.0::DOUBLE ELSE round(((doc_id%3<>0)::INT + (doc_id%4<>0)::INT + (doc_id%5<>0)::INT)/3.0::DOUBLE,4) END field_completeness FROM documents""")
def met_field_completeness(t: Tables):
    i = F.col("doc_id")
    parsed = F.struct(
        F.when(i % 3 == 0, " 　").otherwise(F.col("text")).alias("a"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("b"), F.when(i % 5 != 0, i).alias("c"),
    )
    rows = t.table("documents").select("doc_id", F.when(i % 13 != 0, parsed).alias("parsed"), F.struct("lang").alias("sample"))
    return _metrics(rows, [MetricRule("field_completeness", None, {"fields": ["a", "b", "c"]})], "doc_id")


@query("met_rouge1", """WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'),' '), lambda x: x<>'')) w FROM documents),
 c AS (SELECT doc_id, w, count(*) n FROM tok GROUP BY 1,2), l AS (SELECT doc_id, sum(n) n FROM c GROUP BY 1),
 o AS (SELECT a.doc_id, sum(least(a.n,b.n)) o FROM c a JOIN c b ON b.doc_id=a.doc_id+1 AND a.w=b.w GROUP BY 1)
 SELECT d.doc_id, coalesce(round(CASE WHEN o.o>0 THEN 2*(o.o::DOUBLE/l.n)*(o.o::DOUBLE/r.n)/((o.o::DOUBLE/l.n)+(o.o::DOUBLE/r.n)) ELSE 0.0 END,4),0.0) rouge1
 FROM documents d LEFT JOIN l ON l.doc_id=d.doc_id LEFT JOIN l r ON r.doc_id=d.doc_id+1 LEFT JOIN o ON o.doc_id=d.doc_id""")
def met_rouge1(t: Tables):
    return _metrics(t.pair_text, resolve_rules("text", ()), "doc_id")


@query("met_custom_ratio", """SELECT o_orderkey, round(abs(pred)/100.0::DOUBLE,4) fixed, round(abs(pred)/greatest(coalesce(label,1.0),1.0),4) by_field, 0.0::DOUBLE by_text, round(pred/2.0::DOUBLE,4) by_list FROM v_num""", ("v_num",))
def met_custom_ratio(t: Tables):
    rows = t.pair_num.withColumn("sample", F.struct("sample.*", F.array(F.lit(1), F.lit(2)).alias("items"))).withColumn(
        "parsed", F.struct((-F.col("parsed.value")).alias("value"), F.lit("x").alias("word")))
    r = lambda name, **o: MetricRule("custom_ratio", name, o)
    return _metrics(rows, [
        r("fixed", numerator_field="value", denominator_fixed=100), r("by_field", numerator_field="value", denominator_sample_field="value"),
        r("by_text", numerator_field="word", denominator_fixed=3), r("by_list", numerator_field="value", denominator_sample_field="items"),
    ], "o_orderkey")


@query("met_exact_match", """SELECT doc_id, CASE WHEN lower(trim(pred)) IS NOT DISTINCT FROM lower(trim(label)) THEN 1.0::DOUBLE ELSE 0.0 END acc,
 CASE WHEN pred IS NOT DISTINCT FROM label THEN 1.0::DOUBLE ELSE 0.0 END raw_acc FROM v_choice""", ("v_choice",))
def met_exact_match(t: Tables):
    field = {"pred_field": "value", "label_field": "value"}
    return _metrics(t.pair_choice, [MetricRule("exact_match", "acc", field), MetricRule("exact_match", "raw_acc", {**field, "normalize": False})], "doc_id")


@query("met_numeric_error", """SELECT o_orderkey, round(abs(pred-label),6) price_mae, CASE WHEN abs(pred-label)<=50000 THEN 1.0::DOUBLE ELSE 0.0 END price_within_tol FROM v_num""", ("v_num",))
def met_numeric_error(t: Tables):
    return _metrics(t.pair_num, [MetricRule("numeric_error", "price", {"pred_field": "value", "label_field": "value", "tolerance": 50000})], "o_orderkey")


_ONE = "np=0 AND nt=0"


@query("met_list_overlap", f"""SELECT l_orderkey, CASE WHEN {_ONE} THEN 1.0 ELSE round(pr,4) END list_precision, CASE WHEN {_ONE} THEN 1.0 ELSE round(rc,4) END list_recall, CASE WHEN {_ONE} THEN 1.0 ELSE round({_F1},4) END list_f1 FROM v_list_scores""", ("v_list_scores",))
def met_list_overlap(t: Tables):
    return _metrics(t.pair_list, resolve_rules("list", ()), "l_orderkey")


_REASON = """, w AS (SELECT doc_id, trim(regexp_split_to_array(replace(text,chr(10),' '),' ')[2]) ans, list_concat(list_concat(list_filter(regexp_split_to_array(text,chr(10)), lambda x: trim(x)<>''), [source]), [lang]) sup FROM documents),
 n AS (SELECT doc_id, ans, len(sup) total, len(list_filter(sup, lambda x: contains(lower(x), lower(ans)))) hits FROM w) """


@query("met_reasoning", "WITH " + _REASON[2:] + """SELECT doc_id, CASE WHEN coalesce(ans,'')<>'' AND hits>0 THEN 1.0::DOUBLE ELSE 0.0 END reasoning_consistency, CASE WHEN coalesce(ans,'')<>'' THEN round(hits::DOUBLE/total,4) ELSE 0.0 END reasoning_support_coverage FROM n""")
def met_reasoning(t: Tables):
    """Answers are matched in whitespace-normalised text, so the lines are normalised before the comparison."""
    return _metrics(t.pair_reason, [MetricRule("reasoning_consistency", "reasoning", {"final_answer_field": "final_answer", "support_fields": ["steps", "claims", "rationale"]})], "doc_id")


_EV = """, e AS (SELECT doc_id, list_distinct([lower(source), lower(lang), (doc_id%5)::VARCHAR]) p, CASE WHEN doc_id%9<>0 THEN list_distinct([lower(lang),(doc_id%4)::VARCHAR,'x']) ELSE [] END t FROM documents),
 s AS (SELECT doc_id, len(list_intersect(p,t))::DOUBLE i, len(p) np, len(t) nt FROM e), z AS (SELECT doc_id, i/np pr, CASE WHEN nt>0 THEN i/nt ELSE 0.0 END rc FROM s) """


@query("met_evidence", "WITH " + _EV[2:] + f"SELECT doc_id, round(pr,4) evidence_precision, round(rc,4) evidence_recall, round({_F1},4) evidence_f1 FROM z")
def met_evidence(t: Tables):
    return _metrics(t.pair_reason, [MetricRule("claim_evidence_overlap", "evidence", {"label_field": "gt_evidence_ids"})], "doc_id")


@query("met_overlap_raw", f"""SELECT l_orderkey, np::INTEGER pred_count, nt::INTEGER gt_count, ni::INTEGER match_count, pr AS "precision", rc recall, {_F1} f1 FROM v_list_scores""", ("v_list_scores",))
def met_overlap_raw(t: Tables):
    rows = t.pair_list.select("l_orderkey", F.transform("parsed.items", F.lower).alias("p"), F.transform("sample.items", F.lower).alias("t"))
    return M.overlap_counts(rows, F.col("p"), F.col("t")).select("l_orderkey", "pred_count", "gt_count", "match_count", "precision", "recall", "f1")


@query("met_resolve_rules", """SELECT doc_id, CASE WHEN lower(trim(pred)) IS NOT DISTINCT FROM lower(trim(label)) THEN 1.0::DOUBLE ELSE 0.0 END choice_acc,
 CASE WHEN pred IS NOT DISTINCT FROM label THEN 1.0::DOUBLE ELSE 0.0 END own FROM v_choice""", ("v_choice",))
def met_resolve_rules(t: Tables):
    """Preset rules for a task without rules; own rules win; an unknown type falls back to own rules (here none)."""
    own = (MetricRule("exact_match", "own", {"pred_field": "value", "label_field": "value", "normalize": False}),)
    rules = [*resolve_rules("choice", ()), *resolve_rules("choice", own), *resolve_rules("essay", ())]
    return _metrics(t.pair_choice, rules, "doc_id")


def _scores(t: Tables):
    """Ordered scores and an answer type per document."""
    i = F.col("doc_id")
    score = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"))
    share = (i % 10) / F.lit(10.0)
    kinds = [
        F.array(score("choice_acc", share), score("other", F.lit(1.0))), F.array(score("value_mae", F.lit(9.0)), score("value_within_tol", share)),
        F.array(score("stuff1", F.lit(1.0)), score("list_f1", share), score("b_f1", F.lit(1.0))), F.array(score("rouge1", F.when(i % 4 != 0, share))),
        F.array(score("custom", share), score("other", F.lit(0.5))), F.array().cast("array<struct<name:string,value:double>>"),
    ]
    raw = F.element_at(F.array(*kinds), (i % 6 + 1).cast("int"))
    return t.table("documents").select("doc_id", nth(["choice", "number", "list", "text", "essay", "choice"], i % 6).alias("answer_type"), raw.alias("raw_scores"))


_SCORE = "CASE WHEN doc_id%6=5 THEN 0.0::DOUBLE WHEN doc_id%6=3 AND doc_id%4=0 THEN 0.0 ELSE (doc_id%10)/10.0::DOUBLE END"
_PRIMARY = "['exact_match','within_tol','f1','rouge1','custom','exact_match'][(doc_id%6+1)::INT]"


@query("met_primary", f"SELECT doc_id, {_SCORE} primary_score FROM documents")
def met_primary(t: Tables):
    return C.score_cards(_scores(t)).select("doc_id", "primary_score")


@query("met_scorecard", f"""SELECT doc_id, {_PRIMARY} primary_metric, {_SCORE} primary_score, CASE doc_id%6 WHEN 4 THEN false WHEN 5 THEN false WHEN 3 THEN {_SCORE}>=0.3 ELSE {_SCORE}>=0.5 END passed, [2,2,3,1,2,0][(doc_id%6+1)::INT]::INTEGER n_sub FROM documents""")
def met_scorecard(t: Tables):
    return C.score_cards(_scores(t)).select("doc_id", "primary_metric", "primary_score", "passed", F.size("sub_scores").alias("n_sub"))


@query("met_regression", """SELECT o_orderkey, round(c-b,6)+0.0::DOUBLE delta, round(c-b,6) < -0.02::DOUBLE regressed, CASE WHEN round(c-b,6) < -0.02::DOUBLE THEN 'REGRESSION: f1 dropped by '||printf('%.4f',abs(round(c-b,6)))||' (tolerance=0.02)' ELSE 'OK' END details
 FROM (SELECT o_orderkey, 0.8::DOUBLE b, 0.7::DOUBLE+(o_orderkey%21)/100.0::DOUBLE c FROM orders)""")
def met_regression(t: Tables):
    rows = t.table("orders").select("o_orderkey", F.lit(0.8).alias("b"), (F.lit(0.7) + (F.col("o_orderkey") % 21) / F.lit(100.0)).alias("c"))
    return C.check_regression(rows, "c", "b", F.lit("f1")).select("o_orderkey", "delta", "regressed", "details")


_DRIFT = """, s AS (SELECT (ts>=TIMESTAMP '2024-01-16')::INT side, task_name, 'acc' metric, round(sum(m_acc::DECIMAL(38,10))::DOUBLE/count(m_acc),4) v FROM v_results GROUP BY 1,2
 UNION ALL SELECT (ts>=TIMESTAMP '2024-01-16')::INT, task_name, 'gap', round(sum(m_gap::DECIMAL(38,10))::DOUBLE/count(m_gap),4) FROM v_results GROUP BY 1,2)
 SELECT b.task_name, b.metric, b.v baseline_score, c.v current_score, round(c.v-b.v,6) delta, round(c.v-b.v,6) < -0.02::DOUBLE regressed FROM s b JOIN s c ON b.task_name=c.task_name AND b.metric=c.metric AND b.side=0 AND c.side=1"""


@query("met_metric_drift", _DRIFT, ("v_results",))
def met_metric_drift(t: Tables):
    rows = t.results.withColumn("model_id", F.lit("all"))
    part = lambda when: A.task_metric_averages(rows.where(when))
    day = "timestamp '2024-01-16'"
    return C.metric_drift(part(f"ts < {day}"), part(f"ts >= {day}"), ["task_name", "model_id", "step_id"]).select(
        "task_name", "metric", "baseline_score", "current_score", "delta", "regressed")


_CHAIN = """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), lambda x: x <> '') steps FROM documents),
 r AS (SELECT doc_id, steps, CASE doc_id % 3 WHEN 0 THEN list_reverse(steps) WHEN 1 THEN list_concat(['first of all'], steps) ELSE list_sort(steps) END gt FROM l),
 c AS (SELECT doc_id, steps, list_filter(gt, lambda x, i: list_position(gt, x) = i) gt FROM r),
 a AS (SELECT doc_id, len(gt) n, list_filter(list_transform(steps, lambda s: coalesce(list_position(gt, s), 0)), lambda p: p > 0) pos FROM c),
 e AS (SELECT *, list_reduce(list_prepend([]::INTEGER[], list_transform(pos, lambda x: [x])), lambda ends, v: list_concat(list_concat(list_filter(ends, lambda t: t < v[1]), v), ends[len(list_filter(ends, lambda t: t < v[1])) + 2:])) ends FROM a)
 SELECT doc_id, CASE WHEN len(pos) > 0 THEN round(len(ends)::DOUBLE/len(pos), 4) ELSE 0.0 END steps_order, CASE WHEN n > 0 THEN round(len(list_distinct(pos))::DOUBLE/n, 4) ELSE 0.0 END steps_completeness FROM e"""


@query("met_step_order", _CHAIN)
def met_step_order(t: Tables):
    """The lines of a text are the steps; the reference has them backwards, behind another one, or sorted."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    i, tidy = F.col("doc_id"), F.transform(lines, normalize_text)
    chain = F.when(i % 3 == 0, F.reverse(lines)).when(i % 3 == 1, F.concat(F.array(F.lit("First  of all")), lines)).otherwise(F.array_sort(tidy))
    rows = t.table("documents").select("doc_id", F.struct(lines.alias("steps")).alias("parsed"), F.struct(chain.alias("gt_steps")).alias("sample"))
    return _metrics(rows, [MetricRule("reasoning_step_order")], "doc_id")


_NORMAL = "CASE WHEN trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = '' THEN '' ELSE ' '||trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))||' ' END"


@query("met_claim_verifiability", f"""WITH c AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s) <> '')) claim FROM benchmark),
 n AS (SELECT item_id, {_NORMAL.format("claim")} norm FROM c), p AS (SELECT {_NORMAL.format("coalesce(text, '')")} held FROM documents),
 s AS (SELECT norm, count(*) FILTER (norm <> '' AND contains(held, norm)) k FROM (SELECT DISTINCT norm FROM n) CROSS JOIN p GROUP BY 1)
 SELECT item_id, count(*) n_claims, count(*) FILTER (k > 0) n_verifiable, round(count(*) FILTER (k > 0)/count(*)::DOUBLE, 4) verifiable_rate,
 round(count(*) FILTER (k >= 2)/count(*)::DOUBLE, 4) sufficient_rate, min(k) least_support FROM n JOIN s USING (norm) GROUP BY 1""")
def met_claim_verifiability(t: Tables):
    """The sentences of the benchmark items as claims, all documents as evidence."""
    claims = t.table("benchmark").select("item_id", F.explode(sentences(F.col("text"))).alias("claim"))
    return claim_verifiability(claims, t.table("documents"), ["item_id"])


_GATES = (
    G.Gate("acc_floor", "acc", "range", low=0.33), G.Gate("gap_span", "gap", "range", low=0.0, high=9.0), G.Gate("acc_drop", "acc", "drop", tolerance=0.01),
    G.Gate("gap_rise", "gap", "rise", tolerance=0.2),
)
_SIDES = """, s AS (SELECT (ts>=TIMESTAMP '2024-01-16')::INT side, task_name, model_id, 'acc' metric, round(sum(m_acc::DECIMAL(38,10))::DOUBLE/count(m_acc),4) v FROM v_results GROUP BY 1,2,3
 UNION ALL SELECT (ts>=TIMESTAMP '2024-01-16')::INT, task_name, model_id, 'gap', round(sum(m_gap::DECIMAL(38,10))::DOUBLE/count(m_gap),4) FROM v_results GROUP BY 1,2,3),
 d AS (SELECT b.task_name, b.model_id, b.metric, b.v b, c.v c, round(c.v-b.v,6) d FROM s b JOIN s c ON b.side=0 AND c.side=1 AND b.task_name=c.task_name AND b.model_id=c.model_id AND b.metric=c.metric),
 g AS (SELECT task_name, model_id, metric, 0 no, 'acc_floor' gate, CASE WHEN c IS NULL THEN 'missing' WHEN c < 0.33::DOUBLE THEN printf('%.4f', c)||' is under 0.33' END breach FROM d WHERE metric='acc'
  UNION ALL SELECT task_name, model_id, metric, 1, 'gap_span', CASE WHEN c IS NULL THEN 'missing' WHEN c < 0.0 THEN printf('%.4f', c)||' is under 0.0' WHEN c > 9.0 THEN printf('%.4f', c)||' is over 9.0' END FROM d WHERE metric='gap'
  UNION ALL SELECT task_name, model_id, metric, 2, 'acc_drop', CASE WHEN c IS NULL THEN 'missing' WHEN -d > 0.01::DOUBLE THEN 'dropped by '||printf('%.4f', -d)||' (tolerance=0.01)' END FROM d WHERE metric='acc'
  UNION ALL SELECT task_name, model_id, metric, 3, 'gap_rise', CASE WHEN c IS NULL THEN 'missing' WHEN d > 0.2::DOUBLE THEN 'rose by '||printf('%.4f', d)||' (tolerance=0.2)' END FROM d WHERE metric='gap')"""


def _halves(t: Tables):
    part = lambda when: A.task_metric_averages(t.results.where(when))
    day = "timestamp '2024-01-16'"
    return C.metric_drift(part(f"ts < {day}"), part(f"ts >= {day}"), ["task_name", "model_id", "step_id"])


@query("chk_gates", _SIDES + " SELECT task_name, model_id, metric, gate, breach FROM g", ("v_results",))
def chk_gates(t: Tables):
    return G.check_gates(_halves(t), _GATES).select("task_name", "model_id", "metric", "gate", "breach")


@query("chk_gate_verdicts", _SIDES + """, o AS (SELECT *, row_number() OVER (PARTITION BY task_name, model_id ORDER BY breach IS NULL, no, metric) k FROM g)
 SELECT task_name, model_id, count(*) checked, count(breach) breached, count(breach)=0 passed, any_value(gate) FILTER (k=1 AND breach IS NOT NULL) first_gate,
 any_value(metric) FILTER (k=1 AND breach IS NOT NULL) first_metric, any_value(breach) FILTER (k=1) first_breach FROM o GROUP BY 1,2""", ("v_results",))
def chk_gate_verdicts(t: Tables):
    return G.gate_verdicts(G.check_gates(_halves(t), _GATES), ["task_name", "model_id"])


_TAGS = """WITH s AS (SELECT doc_id, ['choice','number','list','text','essay','choice'][(doc_id%6+1)::INT] answer_type, doc_id%6 k, (doc_id%10)/10.0::DOUBLE v FROM documents),
 r AS (SELECT answer_type, list_filter([CASE WHEN k=3 AND doc_id%4=0 THEN 'missing_score' END, CASE WHEN k=0 AND v<1 THEN 'wrong_choice' END, CASE WHEN k=1 AND v<1 THEN 'out_of_tolerance' END,
  CASE WHEN v<0.3 AND (k=2 OR k=3 AND doc_id%4<>0) THEN 'little_overlap' END, CASE WHEN k=5 THEN 'no_score' END,
  CASE WHEN k=5 OR k IN (0,1,2) AND v<0.5 OR k=3 AND (doc_id%4=0 OR v<0.3) THEN 'below_threshold' END], lambda x: x IS NOT NULL) tags FROM s)"""


@query("agg_error_tags", _TAGS + """ SELECT answer_type, tag, count(*) AS "rows", round(count(*)/any_value(n)::DOUBLE, 4) AS share FROM (SELECT answer_type, unnest(tags) tag FROM r) JOIN (SELECT answer_type, count(*) n FROM r GROUP BY 1) USING (answer_type) GROUP BY 1,2""")
def agg_error_tags(t: Tables):
    return G.tag_counts(C.score_cards(_scores(t)), ["answer_type"])


@query("agg_tag_pairs", _TAGS + """ SELECT answer_type, a.tag, b.tag AS other, count(*) AS "rows" FROM (SELECT row_number() OVER () id, * FROM r) x, LATERAL (SELECT unnest(x.tags) tag) a, LATERAL (SELECT unnest(x.tags) tag) b WHERE a.tag < b.tag GROUP BY 1,2,3""")
def agg_tag_pairs(t: Tables):
    return G.tag_pair_counts(C.score_cards(_scores(t)), ["answer_type"])


# Runs are days; a model misses every third day or so.
_RUNS = """, x AS (SELECT 'run-'||strftime(ts, '%Y-%m-%d') run_id, date_trunc('day', ts) run_time, task_name, model_id, prompt_version, 's1' scorer_version, m_acc, m_gap FROM v_results WHERE day(ts)%3 <> event_id%4),
 s AS (SELECT run_id, run_time, task_name, model_id, prompt_version, scorer_version, 'acc' metric, round(avg(m_acc),6) score FROM x GROUP BY ALL
  UNION ALL SELECT run_id, run_time, task_name, model_id, prompt_version, scorer_version, 'gap', round(avg(m_gap),6) FROM x GROUP BY ALL),
 w AS (SELECT *, last_value(CASE WHEN score IS NOT NULL THEN {'run': run_id, 'score': score} END IGNORE NULLS) OVER (PARTITION BY task_name, model_id, prompt_version, scorer_version, metric ORDER BY run_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) base FROM s),
 d AS (SELECT *, score current_score, base.run baseline_run, base.score baseline_score, round(score - base.score, 6) delta FROM w)"""


def _compared(t: Tables):
    rows = t.results.where(F.dayofmonth("ts") % 3 != F.col("event_id") % 4).select(
        F.concat(F.lit("run-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.date_trunc("day", "ts").alias("run_time"),
        "task_name", "model_id", "prompt_version", F.lit("s1").alias("scorer_version"), F.col("task_metrics").alias("sub_scores"))
    return G.compare_over_runs(G.run_scores(rows))


@query("rep_cross_runs", _RUNS + " SELECT run_id, task_name, model_id, metric, current_score, baseline_run, baseline_score, delta+0.0 delta, delta < -0.02::DOUBLE regressed FROM d", ("v_results",))
def rep_cross_runs(t: Tables):
    return _compared(t).select("run_id", "task_name", "model_id", "metric", "current_score", "baseline_run", "baseline_score", (F.col("delta") + 0.0).alias("delta"), "regressed")


@query("rep_run_overview", _RUNS + """, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY delta, metric, task_name, model_id) k FROM d WHERE delta < 0)
 SELECT d.run_id, count(*) scores, count(d.baseline_score) compared, count(*) FILTER (d.delta < -0.02::DOUBLE) regressed, count(*) FILTER (d.delta > 0) improved,
 any_value(o.delta) worst_delta, any_value(o.metric) worst_metric, any_value(o.task_name) worst_task_name, any_value(o.model_id) worst_model_id FROM d LEFT JOIN o ON o.run_id = d.run_id AND o.k = 1 GROUP BY 1""", ("v_results",))
def rep_run_overview(t: Tables):
    return G.cross_run_report(_compared(t)).select(
        "run_id", "scores", "compared", "regressed", "improved", "worst_delta", "worst_metric", "worst_task_name", "worst_model_id")


# --- whole runs ------------------------------------------------------------------------------------------

_TASK = TaskSpec.from_dict({
    "name": "probe", "prompt_version": "probe.v1", "system": "s", "user": "Text: {text}",
    "field_mapping": {"lang": "label_lang", "text": "ref"},
    "parse_schema": [{"field": "label", "type": "str"}, {"field": "score", "type": "int", "lo": 0, "hi": 100000}, {"field": "summary", "type": "str"}],
    "metrics": [
        {"type": "exact_match", "name": "lang_acc", "pred_field": "label", "label_field": "label_lang"},
        {"type": "reference_rouge", "output_field": "summary", "reference_field": "ref"},
        {"type": "field_completeness", "fields": ["label", "score", "summary"]},
    ],
})


def _probe_samples(t: Tables):
    return t.table("documents").select(F.col("doc_id").cast("string").alias("sample_id"), "lang", "text")


def _probe_calls(t: Tables, models=("m0", "m3")):
    """Recorded answers for two models; documents in Spanish have none, every thirteenth call failed."""
    i = F.col("doc_id")
    rows = t.outputs.where("lang <> 'es'").withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    ok = i % 13 != 0
    return rows.select(
        i.cast("string").alias("sample_id"), "model_id", F.lit(0).alias("repeat_idx"), F.when(ok, F.col("output_text")).otherwise("").alias("content"),
        (i % 100).cast("int").alias("prompt_tokens"), (i % 40).cast("int").alias("completion_tokens"), (F.col("n_chars") / F.lit(4.0)).alias("latency_ms"),
        ok.alias("success"), F.when(ok, "").otherwise("gateway_error: timeout").alias("error"), F.lit(0).alias("retry_count"),
        *[F.lit("").alias(c) for c in ("error_type", "error_stage", "error_code")],
    )


_RUN_CTE = """WITH d AS (SELECT doc_id, lang, text, n_chars, m model_id, lang<>'es' AS recorded, lang<>'es' AND doc_id%13<>0 AS ok, lang<>'es' AND doc_id%13<>0 AND doc_id%7<5 AS parsed,
  regexp_matches(lower(text),'[a-z0-9]') AS has_word FROM documents, (SELECT unnest(['m0','m3']) m)),
 r AS (SELECT doc_id::VARCHAR sample_id, model_id, ok success, parsed parse_success,
  CASE WHEN NOT recorded THEN 'gateway_failure' WHEN NOT ok THEN 'timeout' WHEN NOT parsed THEN 'schema_mismatch' ELSE '' END error_type,
  CASE WHEN recorded THEN (doc_id%100)+(doc_id%40) ELSE 0 END::INTEGER total_tokens,
  CASE WHEN recorded AND model_id='m0' THEN round((doc_id%100)/1000.0::DOUBLE*0.00015::DOUBLE+(doc_id%40)/1000.0::DOUBLE*0.0006::DOUBLE,8) ELSE 0.0::DOUBLE END cost_estimate,
  CASE WHEN recorded THEN CASE WHEN parsed THEN 1.0 ELSE 0.0 END END::DOUBLE lang_acc, CASE WHEN recorded THEN CASE WHEN parsed AND has_word THEN 1.0 ELSE 0.0 END END::DOUBLE rouge1,
  CASE WHEN recorded THEN round(n_chars/4.0::DOUBLE,2) ELSE 0.0 END::DOUBLE latency_ms FROM d) """


def _task_results(t: Tables):
    return RUN.task_run(_probe_samples(t), t.models, _probe_calls(t), _TASK, ["m0", "m3"], run_id="r1")


@query("run_task", _RUN_CTE + "SELECT * FROM r")
def run_task(t: Tables):
    """Grid, recorded answers, parsing, scoring, pricing and error typing in one plan."""
    m = lambda name: F.get(F.filter("task_metrics", lambda x: x["name"] == name), F.lit(0))["value"].alias(name)
    return _task_results(t).select(
        "sample_id", "model_id", "success", "parse_success", "error_type", "total_tokens", "cost_estimate", m("lang_acc"), m("rouge1"), "latency_ms")


@query("run_task_summary", _RUN_CTE + """SELECT model_id, count(*) request_count, count(*) FILTER (success) success_count, round(count(*) FILTER (parse_success)/count(*)::DOUBLE,4) parse_rate,
 round(quantile_disc(latency_ms,0.95),2) p95_latency_ms, round(sum(cost_estimate::DECIMAL(38,10))::DOUBLE,6) cost_estimate FROM r GROUP BY 1""")
def run_task_summary(t: Tables):
    """As in a run: rows are stored first, then summed up from the store, so no answer is parsed twice."""
    path = shared_dir(t.spark, "results")
    W.append_results(_task_results(t), path, "parquet")
    return A.summarize(t.spark.read.parquet(path)).select("model_id", "request_count", "success_count", "parse_rate", "p95_latency_ms", "cost_estimate")


@query("udf_task", _RUN_CTE + "SELECT sample_id, success, parse_success, lang_acc FROM r WHERE model_id='m0'")
def udf_task(t: Tables):
    """A task given as a plain dict by its user."""
    spec = TaskSpec.from_dict({**{"name": "mine", "user": "{text}", "field_mapping": {"lang": "label_lang"}},
                               "parse_schema": [{"field": "label"}], "metrics": [{"type": "exact_match", "name": "lang_acc", "pred_field": "label", "label_field": "label_lang"}]})
    out = RUN.task_run(_probe_samples(t), t.models, _probe_calls(t, ("m0",)), spec, ["m0"])
    return out.select("sample_id", "success", "parse_success", F.get("task_metrics", F.lit(0))["value"].alias("lang_acc"))


class _WordCountTask:
    """A task in code: three DataFrame steps used through ``transform``."""

    def build_requests(self, df):
        return df.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))

    def parse(self, df):
        return df.withColumn("parsed", F.struct(F.size(F.split(F.element_at("messages", 1)["content"], " ")).alias("words")))

    def metrics(self, df):
        return df.withColumn("words", F.col("parsed.words"))


@query("udf_task_py", "SELECT sample_id, len(string_split(body,' '))::INTEGER words FROM v_samples", ("v_samples",))
def udf_task_py(t: Tables):
    task = _WordCountTask()
    return _probe_samples(t).transform(task.build_requests).transform(task.parse).transform(task.metrics).select("sample_id", "words")


@query("udf_metric", "SELECT doc_id, round(length(coalesce(pred,''))/10.0::DOUBLE,4) pred_len FROM v_choice", ("v_choice",))
def udf_metric(t: Tables):
    """A metric type added by its user, here one backed by an Arrow UDF."""
    @F.pandas_udf("double")
    def length_share(s: pd.Series) -> pd.Series:
        return s.fillna("").str.len() / 10.0

    M.register_metric("length_share", lambda rule, sides: [(rule.name, F.round(length_share(sides.pick("parsed", rule.get("pred_field"))[0]), 4))])
    return _metrics(t.pair_choice, [MetricRule("length_share", "pred_len", {"pred_field": "value"})], "doc_id")


@query("udf_report", "SELECT '* '||task_name||': '||count(*) AS line FROM v_results GROUP BY task_name", ("v_results",))
def udf_report(t: Tables):
    """A reporter of the user's own: named tables in, lines out."""
    def reporter(tables):
        rows = tables["results"].groupBy("task_name").agg(F.count("*").cast("string").alias("n"))
        return rows.select(F.struct("task_name").alias("pos"), F.concat(F.lit("* "), "task_name", F.lit(": "), "n").alias("line"))

    return reporter({"results": t.results}).select("line")


@query("run_task_errors", "SELECT sample_id, false success, 'metrics_failure' error_type, 'metrics' error_stage, 0::BIGINT metrics FROM v_samples WHERE doc_id%2=0 UNION ALL SELECT sample_id, true, '', '', 1 FROM v_samples WHERE doc_id%2=1", ("v_samples",))
def run_task_errors(t: Tables):
    """A denominator that is text and no number: the row is an error of its metrics, not a success."""
    spec = TaskSpec.from_dict({"name": "ratio", "user": "{text}", "parse_schema": [{"field": "n", "type": "int", "default": 0, "lo": 0, "hi": 9}],
                               "metrics": [{"type": "custom_ratio", "name": "r", "numerator_field": "n", "denominator_sample_field": "whole"}]})
    samples = t.samples.select("sample_id", "body", F.when(F.col("doc_id") % 2 == 0, "many").otherwise("4").alias("whole")).withColumnRenamed("body", "text")
    calls = samples.select("sample_id", F.lit("m0").alias("model_id"), F.lit(0).alias("repeat_idx"), F.lit('{"n": 2}').alias("content"), F.lit(1).alias("prompt_tokens"),
                           F.lit(1).alias("completion_tokens"), F.lit(1.0).alias("latency_ms"), F.lit(True).alias("success"), F.lit(0).alias("retry_count"),
                           *[F.lit("").alias(c) for c in ("error", "error_type", "error_stage", "error_code")])
    out = RUN.task_run(samples, t.models, calls, spec, ["m0"])
    return out.select("sample_id", "success", "error_type", "error_stage", F.size("task_metrics").cast("bigint").alias("metrics"))


@query("run_task_cached", "SELECT sample_id, repeat_idx, doc_id%3=0 AND repeat_idx=0 AS from_cache, CASE WHEN doc_id%3=0 AND repeat_idx=0 THEN 'new' ELSE 'called' END AS output_text FROM v_samples, (SELECT unnest([0,1]) repeat_idx) WHERE NOT (doc_id%5=0 AND repeat_idx=1)", ("v_samples",))
def run_task_cached(t: Tables):
    """Resume and cache in one run: finished repeats are left out, the last written of two cached answers counts, and of two recorded calls one."""
    spec = TaskSpec.from_dict({"name": "plain", "user": "{text}"})
    samples = t.samples.select("sample_id", "doc_id", F.col("body").alias("text"))
    every = samples.withColumn("repeat_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"model_id": F.lit("m0"), "task_name": F.lit("plain"), "step_id": F.lit("__task__")})
    done = every.where("doc_id % 5 = 0 and repeat_idx = 1").select("sample_id", "task_name", "step_id", "model_id", "repeat_idx")
    usage = {"prompt_tokens": F.lit(1), "completion_tokens": F.lit(1), "latency_ms": F.lit(1.0), "success": F.lit(True), "retry_count": F.lit(0),
             **{c: F.lit("") for c in ("error", "error_type", "error_stage", "error_code")}}
    keyed = RUN.pending_requests(samples, t.models, spec, ["m0"], 2).where("doc_id % 3 = 0 and repeat_idx = 0").select("cache_key")
    cache = keyed.withColumns({"content": F.lit("old"), "written_at": F.lit(1), **usage}).unionByName(keyed.withColumns({"content": F.lit("new"), "written_at": F.lit(2), **usage}))
    calls = every.select("sample_id", "model_id", "repeat_idx").withColumns({"content": F.lit("called"), "timestamp": F.lit(2), **usage})
    calls = calls.unionByName(calls.withColumns({"content": F.lit("stale"), "timestamp": F.lit(1)}))
    out = RUN.task_run(samples, t.models, calls, spec, ["m0"], 2, done=done, cache=stored_once(cache, "cache"))
    return out.select("sample_id", "repeat_idx", "from_cache", "output_text")


# --- workflow --------------------------------------------------------------------------------------------

_FLOW = WorkflowSpec("flow", "v1", (WorkflowStep("s0", "label"), WorkflowStep("s1", "plain", "$active", "s0"), WorkflowStep("s2", "label", "$active", "s1"), WorkflowStep("s3", "label", "$active", "s9")))
_FLOW_TASKS = {
    "label": TaskSpec.from_dict({"name": "label", "user": "x", "parse_schema": [{"field": "label"}]}),
    "plain": TaskSpec.from_dict({"name": "plain", "user": "x"}),
}


def _flow(t: Tables, spec=_FLOW):
    i = F.col("doc_id")
    text = F.when(F.col("k") == 0, F.col("output_text")).otherwise(F.concat(F.lit('{"label":"'), "lang", F.lit('"}')))
    calls = t.outputs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        i.cast("string").alias("sample_id"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("step_id"), text.alias("content"),
        F.lit(10).alias("prompt_tokens"), F.lit(20).alias("completion_tokens"), F.lit(1.5).alias("latency_ms"), ((i + F.col("k")) % 9 != 0).alias("success"),
        F.lit("").alias("error"), F.lit(1).alias("retry_count"), *[F.lit("").alias(c) for c in ("error_type", "error_stage", "error_code")],
        F.lit(False).alias("from_cache"),
    )
    return RUN.workflow_run(_probe_samples(t), t.models, calls, spec, {s.id: MODEL_IDS[n % 4] for n, s in enumerate(spec.steps)}, _FLOW_TASKS)


_FLOW_CTE = """WITH d AS (SELECT doc_id, doc_id%9<>0 AND doc_id%7<5 g0, (doc_id+1)%9<>0 c1, (doc_id+2)%9<>0 c2 FROM documents),
 s AS (SELECT doc_id, 's0' step_id, true runs, doc_id%9<>0 success, g0 parsed FROM d UNION ALL SELECT doc_id, 's1', g0, g0 AND c1, false FROM d
  UNION ALL SELECT doc_id, 's2', g0 AND c1, g0 AND c1 AND c2, g0 AND c1 AND c2 FROM d UNION ALL SELECT doc_id, 's3', false, false, false FROM d) """


@query("run_workflow_steps", _FLOW_CTE + """SELECT doc_id::VARCHAR sample_id, step_id, success, parsed parse_success, step_id<>'s1' parse_applicable, CASE WHEN runs THEN 30 ELSE 0 END::INTEGER total_tokens,
 CASE WHEN runs AND NOT success THEN 'unknown_error' WHEN runs AND step_id<>'s1' AND NOT parsed THEN 'schema_mismatch' WHEN runs THEN '' WHEN step_id='s3' THEN 'upstream_missing' ELSE 'upstream_parse_failed' END error_type,
 CASE WHEN runs THEN '' WHEN step_id='s3' THEN 'upstream_missing: upstream_s9_missing' WHEN step_id='s1' THEN 'upstream_parse_failed: upstream_s0_parse_failed' ELSE 'upstream_parse_failed: upstream_s1_parse_failed' END error FROM s""")
def run_workflow_steps(t: Tables):
    return _flow(t).where("mode = 'workflow_step'").select(
        "sample_id", "step_id", "success", "parse_success", "parse_applicable", "total_tokens", "error_type", "error")


_FLOW3 = WorkflowSpec("flow3", "v1", _FLOW.steps[:3])


@query("run_workflow_e2e", _FLOW_CTE + """SELECT doc_id::VARCHAR sample_id, 'm0+m1+m2' model_id, bool_and(success AND (parsed OR step_id='s1')) success, coalesce(arg_max(step_id<>'s1', step_id) FILTER (runs), true) parse_applicable,
 bool_or(parsed) FILTER (step_id='s2') parse_success, (30*count(*) FILTER (runs))::INTEGER total_tokens, (count(*) FILTER (runs))::INTEGER retry_count, 1.5::DOUBLE*count(*) FILTER (runs) latency_ms FROM s WHERE step_id<>'s3' GROUP BY doc_id""")
def run_workflow_e2e(t: Tables):
    rows = _flow(t, _FLOW3).where("mode = 'workflow_e2e'")
    return rows.select("sample_id", "model_id", "success", "parse_applicable", "parse_success", "total_tokens", "retry_count", "latency_ms")


_REQUESTS = """SELECT sample_id, CASE WHEN doc_id%4=0 THEN 's0' ELSE 's1' END step_id, CASE WHEN doc_id%4=0 THEN 'm0' ELSE 'm1' END model_id, CASE WHEN doc_id%4=0 THEN 'start' ELSE '{"label":"'||lang||'"}' END AS given
 FROM v_samples WHERE doc_id%4 IN (0,1)"""


def _step_requests(t: Tables, cache=None):
    """Of four samples in a row one has nothing done, one its first step, one a failed first step, one both steps."""
    tasks = {"first": TaskSpec.from_dict({"name": "first", "user": "start", "parse_schema": [{"field": "label"}]}), "second": TaskSpec.from_dict({"name": "second", "user": "{step_input}"})}
    flow = WorkflowSpec("flow", "v1", (WorkflowStep("s0", "first"), WorkflowStep("s1", "second", "$active", "s0")))
    k = F.col("doc_id") % 4
    done = t.samples.where(k > 0).withColumn("step_id", F.explode(F.when(k == 3, F.array(F.lit("s0"), F.lit("s1"))).otherwise(F.array(F.lit("s0"))))).select(
        "sample_id", "step_id", (k != 2).alias("success"), (F.col("step_id") == "s0").alias("parse_applicable"), (k != 2).alias("parse_success"),
        F.to_json(F.struct(F.col("lang").alias("label"))).alias("parsed"), F.lit("text").alias("output_text"))
    return RUN.workflow_requests(_probe_samples(t), t.models, done, flow, {"s0": "m0", "s1": "m1"}, tasks, cache=cache)


@query("run_workflow_requests", _REQUESTS, ("v_samples",))
def run_workflow_requests(t: Tables):
    rows = _step_requests(t)
    return rows.select("sample_id", "step_id", "model_id", F.element_at("messages", -1)["content"].alias("given"))


@query("run_workflow_cached", f"SELECT sample_id, step_id, step_id='s1' AS from_cache, CASE WHEN step_id='s1' THEN upper(given) END AS content FROM ({_REQUESTS})", ("v_samples",))
def run_workflow_cached(t: Tables):
    asked = _step_requests(t).where("step_id = 's1'")
    cache = stored_once(asked.select("cache_key", F.upper(F.element_at("messages", -1)["content"]).alias("content")), "cache")
    return _step_requests(t, cache).select("sample_id", "step_id", "from_cache", "content")
