"""Projections, filters, checks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.errors import append_error
from scorelake.operators import aggregates as A
from scorelake.operators import checks as K
from scorelake.operators import grid as G
from scorelake.operators import metrics as M
from scorelake.operators import projections as P
from scorelake.operators import scorecards as C
from scorelake.operators.ranking import nlargest
from scorelake.plans import plates as PL
from scorelake.plans.adapters import MODEL_IDS, Tables, nth, sql_list
from scorelake.plans.registry import query
from scorelake.spec import TaskSpec

# --- projections -----------------------------------------------------------------------------------------

@query("prj_field_mapping", "SELECT sample_id, lang, lang label_lang, gt_quality label FROM v_samples", ("v_samples",))
def prj_field_mapping(t: Tables):
    rows = t.samples.select("sample_id", "lang", "gt_quality")
    return P.map_fields(rows, {"lang": "label_lang", "gt_quality": "label", "absent": "nowhere"}).drop("gt_quality")


_TASK = TaskSpec.from_dict({
    "name": "probe", "prompt_version": "probe.v2", "system": "Be brief.", "user": "Lang {lang}. Items: {items_json} / {missing_json}\nText: {text}{tags_section}",
    "serialize_fields": ["items", "missing"], "optional_sections": [["tags", " Tags: "]],
    "few_shot": [[" ask ", "answer"], ["ask2", " answer2 "]],
})


def _request_rows(t: Tables):
    d = t.table("documents")
    tags = F.when(F.col("doc_id") % 3 != 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"items": F.array(F.struct(F.col("source").alias("title"), F.col("n_chars").alias("n"))), "tags": tags})


@query("prj_requests", """SELECT doc_id, 'probe.v2' prompt_version, 'Be brief.' system_text,
 'Lang '||lang||'. Items: [{"title":"'||source||'","n":'||n_chars||'}] / []'||chr(10)||'Text: '||text||CASE WHEN doc_id%3<>0 THEN ' Tags: '||source||'、'||lang ELSE '' END user_text FROM documents""")
def prj_requests(t: Tables):
    rows = P.build_requests(_request_rows(t), _TASK, few_shot=False)
    m = F.col("messages")
    return rows.select("doc_id", "prompt_version", m[0]["content"].alias("system_text"), m[1]["content"].alias("user_text"))


@query("prj_few_shot", "SELECT doc_id, 6::INTEGER n, 'system,user,assistant,user,assistant,user' roles, 'ask' m1, 'answer2' m4 FROM documents")
def prj_few_shot(t: Tables):
    m = F.col("messages")
    return P.build_requests(_request_rows(t), _TASK).select(
        "doc_id", F.size(m).alias("n"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
        m[1]["content"].alias("m1"), m[4]["content"].alias("m4"),
    )


@query("prj_optional_section", "SELECT doc_id, CASE WHEN doc_id%3<>0 THEN ' Tags: '||source||'、'||lang ELSE '' END section FROM documents")
def prj_optional_section(t: Tables):
    rows = _request_rows(t)
    return rows.select("doc_id", P.optional_section(rows, "tags", " Tags: ").alias("section"))


@query("prj_result_row", """SELECT sample_id, repeat_idx, 'result_row.v1' schema_version, 'r1' run_id, success, error,
 CASE WHEN NOT success THEN list_extract(%s,(event_id%%10+1)::INT) WHEN parse_applicable AND NOT parse_success THEN 'schema_mismatch' ELSE '' END error_type,
 round(latency_ms,2) latency_ms, total_tokens, cost_estimate FROM v_costed
 UNION ALL SELECT sample_id, repeat_idx, 'result_row.v1','r1', false, 'build_prompt_error: bad', 'prompt_build_failure', 0.0, 0, 0.0 FROM v_costed WHERE error_stage='build_prompt'"""
       % sql_list(["prompt_build_failure", "timeout", "rate_limit", "refusal", "gateway_failure", "parse_failure", "metrics_failure",
                   "upstream_missing", "upstream_parse_failed", "unknown_error"]), ("v_costed",))
def prj_result_row(t: Tables):
    base = G.with_price(t.results, t.models).withColumns({
        "content": F.col("output_text"), "parsed_json": F.lit(None).cast("string"),
        "error_type": F.lit(""), "error_stage": F.lit(""), "error_code": F.lit(""),
    })
    good = P.called_rows(base, {"run_id": F.lit("r1"), "mode": F.lit("task")})
    message = F.lit("build_prompt_error: bad")
    bad = P.error_rows(
        t.results.where("error_stage = 'build_prompt'").select("sample_id", "repeat_idx", "task_name", "model_id"),
        {"run_id": F.lit("r1"), "mode": F.lit("task")}, message,
        F.lit("prompt_build_failure"), F.lit("build_prompt"), F.lit("build_prompt_error"),
    )
    return good.unionByName(bad).select(
        "sample_id", "repeat_idx", "schema_version", "run_id", "success", "error", "error_type", "latency_ms", "total_tokens", "cost_estimate"
    )


@query("prj_params_merge", """SELECT event_id, CASE WHEN event_id%2=0 THEN 'step' ELSE 'global' END temperature, 'default' top_p, task_name tag,
 CASE WHEN event_id%2=0 THEN 4 ELSE 3 END::INTEGER n FROM v_results""", ("v_results",))
def prj_params_merge(t: Tables):
    defaults = P.map_literal({"temperature": "default", "top_p": "default"})
    overall = F.create_map(F.lit("temperature"), F.lit("global"), F.lit("tag"), F.col("task_name"))
    step = F.when(F.col("event_id") % 2 == 0, P.map_literal({"temperature": "step", "seed": "1"}))
    m = P.merge_maps(defaults, overall, step)
    return t.results.select(
        "event_id", m["temperature"].alias("temperature"), m["top_p"].alias("top_p"), m["tag"].alias("tag"), F.size(m).alias("n")
    )


@query("prj_active_model", """SELECT event_id, CASE WHEN event_id%3=0 THEN 'mapped' WHEN event_id%2=0 THEN 'm9' ELSE model_id END model_id FROM v_results""", ("v_results",))
def prj_active_model(t: Tables):
    i = F.col("event_id")
    declared = F.when(i % 2 == 0, "$active").otherwise(F.col("model_id"))
    return t.results.select("event_id", P.active_model(declared, "m9", F.when(i % 3 == 0, "mapped")).alias("model_id"))


_CONVERT = """SELECT news_id::VARCHAR sample_id, ticker, sec_short_name, coalesce(exchange_cd,'') exchange_cd, trade_date, coalesce(news_publish_time,'') news_publish_time,
 coalesce(news_title,'') news_title, coalesce(news_body,'') news_body, coalesce(news_summary,'') gt_summary,
 CASE coalesce(sentiment,0) WHEN -1 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END gt_sentiment, coalesce(round(sentiment_score,6),0.0) gt_sentiment_score FROM v_news"""


@query("prj_convert_news", _CONVERT, ("v_news",))
def prj_convert_news(t: Tables):
    return P.convert_news(t.news)


@query("prj_plate_derive", """SELECT id, name, "desc", avg_pcp_pct, core_avg_pcp_pct, fund_flow_yi, total_stocks, rise_ratio, core_ratio,
 strftime(updated_at,'%Y-%m-%d %H:%M:%S') updated FROM v_derived""", ("v_derived",))
def prj_plate_derive(t: Tables):
    return t.derived.select(
        "id", "name", "desc", "avg_pcp_pct", "core_avg_pcp_pct", "fund_flow_yi", "total_stocks", "rise_ratio", "core_ratio",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


@query("prj_snapshot", """SELECT 's'||turn||'_'||conv_id||':m'||(turn%4) AS key, '***' api_key, turn::VARCHAR temperature, 'x' extra FROM conversations""")
def prj_snapshot(t: Tables):
    steps = t.table("conversations").select(
        F.concat(F.lit("s"), F.col("turn").cast("string"), F.lit("_"), F.col("conv_id").cast("string")).alias("step_id"),
        F.concat(F.lit("m"), (F.col("turn") % 4).cast("string")).alias("model_id"),
        F.create_map(F.lit("temperature"), F.col("turn").cast("string")).alias("params_override"),
    )
    p = F.col("params")
    return P.step_snapshot(steps, t.models, {"temperature": "9", "extra": "x"}).select(
        "key", p["api_key"].alias("api_key"), p["temperature"].alias("temperature"), p["extra"].alias("extra")
    )


# --- filters ---------------------------------------------------------------------------------------------

_FAILED = "(NOT success OR (parse_applicable AND NOT parse_success))"


@query("flt_failed", f"SELECT sample_id, repeat_idx FROM v_results WHERE {_FAILED}", ("v_results",))
def flt_failed(t: Tables):
    return A.failed_rows(t.results).select("sample_id", "repeat_idx")


@query("flt_nonempty", "SELECT news_id, news_body, news_summary FROM v_news WHERE news_body<>'' AND news_summary<>''", ("v_news",))
def flt_nonempty(t: Tables):
    return K.non_empty(t.news.select("news_id", "news_body", "news_summary"), "news_body", "news_summary")


@query("flt_desc_len", """SELECT id, true AS kept FROM v_plates WHERE length(trim("desc"))>=10 UNION ALL SELECT id, false FROM v_plates WHERE length(trim("desc"))<10""", ("v_plates",))
def flt_desc_len(t: Tables):
    return t.plates.select("id", K.long_enough(F.col("desc")).alias("kept"))


@query("flt_workflow_mode", "SELECT sample_id, repeat_idx, mode FROM v_results WHERE mode IN ('workflow_step','workflow_e2e')", ("v_results",))
def flt_workflow_mode(t: Tables):
    return K.workflow_rows(t.results).select("sample_id", "repeat_idx", "mode")


@query("flt_core", "SELECT plate_id, symbol FROM v_stocks WHERE core_flag=100", ("v_stocks",))
def flt_core(t: Tables):
    return K.core_only(t.stocks).select("plate_id", "symbol")


@query("flt_dropna", "SELECT id FROM v_derived WHERE rise_ratio IS NOT NULL AND fund_flow_yi IS NOT NULL", ("v_derived",))
def flt_dropna(t: Tables):
    return K.drop_nulls(t.derived, "rise_ratio", "fund_flow_yi").select("id")


@query("flt_scored", "SELECT event_id FROM v_results WHERE success AND event_id%4<>0 AND event_id%5<>0", ("v_results",))
def flt_scored(t: Tables):
    i = F.col("event_id")
    rows = t.results.withColumn("parsed", F.when(i % 4 == 0, None).when(i % 5 == 0, "{ }").otherwise(F.to_json(F.struct("sample_id"))))
    return K.scored_rows(rows).select("event_id")


# --- checks ----------------------------------------------------------------------------------------------

@query("chk_cache_cost", "SELECT event_id FROM v_results WHERE from_cache AND event_id%4=0", ("v_results",))
def chk_cache_cost(t: Tables):
    rows = t.results.withColumn("cost_estimate", F.when(F.col("event_id") % 4 == 0, 0.001).when(F.col("event_id") % 5 != 0, 0.0))
    return K.cache_cost_violations(rows).select("event_id")


@query("chk_answer_contract", """SELECT sample_id, reason FROM (
 SELECT doc_id::VARCHAR sample_id, unnest(list_filter([CASE WHEN doc_id%6=0 THEN 'missing answer_type' END, CASE WHEN doc_id%7=0 THEN 'missing prediction' END,
 CASE WHEN doc_id%6=5 THEN 'unknown answer_type' END, CASE WHEN doc_id%4=1 THEN 'missing meta.schema_version' END], lambda x: x IS NOT NULL)) reason FROM documents)""")
def chk_answer_contract(t: Tables):
    i = F.col("doc_id")
    meta = F.when(i % 4 == 0, None).when(i % 4 == 1, P.map_literal({"prompt_version": "v1"})).otherwise(P.map_literal({"schema_version": "v1"}))
    answers = t.table("documents").select(
        F.lit("t").alias("task_id"), i.cast("string").alias("sample_id"),
        nth([None, "choice", "number", "list", "text", "essay"], i % 6).alias("answer_type"),
        F.when(i % 7 != 0, F.create_map(F.lit("value"), F.col("lang"))).alias("prediction"),
        F.create_map(F.lit("value"), F.col("lang")).alias("ground_truth"), meta.alias("meta"),
    )
    return K.answer_contract_violations(answers).select("sample_id", "reason")


@query("chk_metric_types", "SELECT p_partkey::VARCHAR AS owner, 'bleu' metric_type FROM part WHERE p_partkey%9=8")
def chk_metric_types(t: Tables):
    names = ["field_completeness", "reference_rouge", "custom_ratio", "exact_match", "numeric_error", "list_overlap",
             "reasoning_consistency", "claim_evidence_overlap", "bleu"]
    rules = t.table("part").select(F.col("p_partkey").cast("string").alias("owner"), nth(names, F.col("p_partkey") % 9).alias("metric_type"))
    return K.unknown_metric_types(rules, M.known_metric_types()).select("owner", "metric_type")


# --- joins -----------------------------------------------------------------------------------------------

_GRID = "SELECT doc_id::VARCHAR sample_id, m model_id, r::INTEGER repeat_idx FROM documents, (SELECT unnest(['m0','m1','m2','m3']) m), (SELECT unnest(range(0,2)) r)"
_DONE = "SELECT DISTINCT user_id::VARCHAR sample_id, 'm'||(event_id%4) model_id, (event_id%3)::INTEGER repeat_idx FROM events WHERE event_type='click'"


def _grid(t: Tables):
    return G.work_grid(t.table("documents").select(F.col("doc_id").cast("string").alias("sample_id")), "click", MODEL_IDS, 2)


def _done(t: Tables):
    """Finished keys of the grid's task; repeats run over three values, the third being outside the grid."""
    rows = t.results.withColumn("repeat_idx", F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 3).cast("string")).otherwise("bad"))
    return G.completed_keys(rows)


@query("jn_work_grid", _GRID)
def jn_work_grid(t: Tables):
    return _grid(t).select("sample_id", "model_id", "repeat_idx")


@query("jn_resume_anti", f"SELECT * FROM ({_GRID}) EXCEPT SELECT * FROM ({_DONE})")
def jn_resume_anti(t: Tables):
    return G.pending_work(_grid(t), _done(t)).select("sample_id", "model_id", "repeat_idx")


@query("jn_sample_division", f"SELECT DISTINCT sample_id FROM (SELECT * FROM ({_GRID}) EXCEPT SELECT * FROM ({_DONE}))")
def jn_sample_division(t: Tables):
    samples = t.table("documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return G.unfinished_samples(samples, _done(t), "click", MODEL_IDS, 2)


@query("jn_workflow_resume", "SELECT doc_id::VARCHAR sample_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type='view' AND event_id%2=0)")
def jn_workflow_resume(t: Tables):
    done = G.completed_keys(t.results.withColumn("step_id", F.when(F.col("event_id") % 2 == 0, "__e2e__").otherwise("s1")))
    samples = t.table("documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return G.unfinished_workflow_samples(samples, done, "view")


@query("jn_cache_lookup", """SELECT conv_id, turn, role='user' AND turn%4<>3 AS from_cache, CASE WHEN role='user' AND turn%4<>3 THEN upper(role) END AS content FROM conversations""")
def jn_cache_lookup(t: Tables):
    return G.cache_lookup(t.requests, t.cache).select("conv_id", "turn", "from_cache", "content")


@query("jn_upstream", """SELECT s.sample_id, s.step_id,
 CASE WHEN s.input_from='sample' THEN 'sample' WHEN u.step_id IS NULL THEN 'missing' WHEN NOT u.success OR (u.parse_applicable AND NOT u.parse_success) THEN 'parse_failed' ELSE 'ok' END upstream_state,
 CASE WHEN s.input_from='sample' THEN NULL WHEN u.step_id IS NULL THEN 'upstream_'||s.input_from||'_missing' WHEN NOT u.success OR (u.parse_applicable AND NOT u.parse_success) THEN 'upstream_'||s.input_from||'_parse_failed' END upstream_error,
 CASE WHEN s.input_from<>'sample' AND u.step_id IS NOT NULL AND u.success AND (u.parse_success OR NOT u.parse_applicable) THEN CASE WHEN u.parse_applicable THEN u.parsed ELSE u.raw END END step_input
 FROM v_steps s LEFT JOIN v_steps u ON s.sample_id=u.sample_id AND s.input_from=u.step_id AND u.ord<s.ord""", ("v_steps",))
def jn_upstream(t: Tables):
    return G.resolve_upstream(t.steps).select("sample_id", "step_id", "upstream_state", "upstream_error", "step_input")


@query("jn_price", "SELECT event_id, model_id, p_in input_per_1k, p_out output_per_1k FROM v_results JOIN v_models USING (model_id)", ("v_results", "v_models"))
def jn_price(t: Tables):
    return G.with_price(t.results, t.models).select("event_id", "model_id", "price.input_per_1k", "price.output_per_1k")


@query("jn_pred_truth", "SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d USING (doc_id)")
def jn_pred_truth(t: Tables):
    return G.join_truth(t.table("labels").select("doc_id", "quality"), t.table("documents").select("doc_id", "lang"), "doc_id")


@query("jn_plate_stock", """SELECT p.id, p.name, coalesce(sum((core_flag=100)::INT),0)::BIGINT core_count, count(symbol) total_count FROM v_plates p LEFT JOIN v_stocks s ON p.id=s.plate_id GROUP BY ALL""", ("v_plates", "v_stocks"))
def jn_plate_stock(t: Tables):
    return PL.core_counts(t.plates, t.stocks, None, None).drop("desc")


STRIP_SQL = "left(regexp_replace(regexp_replace(regexp_replace(html_answer,'<[^>]+>','','g'),'&[a-zA-Z]+;','','g'),'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g'),500)"
ASSOCIATION = f"""SELECT 'SA_'||k.id sample_id, k.name plate_name, trim(k."desc") plate_desc, coalesce(c.names,'') chains, k.n::INTEGER core_stocks_count, g.symbols gt_stocks, nullif(i.intro,'') plate_intro
 FROM (SELECT p.id, p.name, p."desc", sum((core_flag=100)::INT) n FROM v_plates p JOIN v_stocks s ON p.id=s.plate_id WHERE length(trim("desc"))>=10 GROUP BY ALL HAVING sum((core_flag=100)::INT) BETWEEN 5 AND 50) k
 LEFT JOIN (SELECT plate_id, string_agg(symbol,',' ORDER BY symbol) symbols FROM v_stocks WHERE core_flag=100 GROUP BY 1) g ON g.plate_id=k.id
 LEFT JOIN (SELECT plate_id, string_agg(name,',' ORDER BY "order") names FROM v_chains GROUP BY 1) c ON c.plate_id=k.id
 LEFT JOIN (SELECT plate_id, {STRIP_SQL} intro FROM v_qa WHERE question='板块介绍') i ON i.plate_id=k.id"""
PLATE_VIEWS = ("v_plates", "v_stocks", "v_chains", "v_qa")


@query("jn_plate_children", f"SELECT sample_id, chains, gt_stocks, plate_intro FROM ({ASSOCIATION})", PLATE_VIEWS)
def jn_plate_children(t: Tables):
    return PL.association_set(t.plates, t.stocks, t.chains, t.answers).select(
        "sample_id", F.array_join("chains", ",").alias("chains"), F.array_join("gt_stocks", ",").alias("gt_stocks"), "plate_intro"
    )


@query("jn_name_merge", """SELECT s.plate_id, s.symbol, d.name, d.fund_flow_yi FROM v_stocks s LEFT JOIN v_derived d ON s.plate_id=d.id WHERE core_flag=100""", ("v_stocks", "v_derived"))
def jn_name_merge(t: Tables):
    return G.name_join(K.core_only(t.stocks).select("plate_id", "symbol"), t.derived, ["name", "fund_flow_yi"])


TOPS = """, r AS (SELECT s.symbol, d.name FROM v_stocks s LEFT JOIN v_derived d ON s.plate_id=d.id WHERE core_flag=100),
 ts AS (SELECT symbol FROM r GROUP BY 1 ORDER BY count(DISTINCT name) DESC, symbol LIMIT 20), tn AS (SELECT name FROM r WHERE name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 20)
"""


def _sql_tops(select: str) -> str:
    """SQL that goes on after the views with the top-20 sets of core stocks and plates."""
    return TOPS + select


@query("jn_baseline", """, s AS (SELECT (ts>=TIMESTAMP '2024-01-16')::INT side, task_name, model_id, prompt_version, round(avg(m_acc),4) sc FROM v_results WHERE NOT (ts<TIMESTAMP '2024-01-16' AND model_id='m2' AND task_name='click') GROUP BY 1,2,3,4)
 SELECT coalesce(b.task_name,c.task_name) task_name, coalesce(b.model_id,c.model_id) model_id, b.sc baseline_score, c.sc current_score, round(c.sc-b.sc,6) delta, round(c.sc-b.sc,6) < -0.02::DOUBLE regressed,
 CASE WHEN b.sc IS NULL THEN 'current_only' WHEN c.sc IS NULL THEN 'baseline_only' ELSE 'both' END side
 FROM (SELECT * FROM s WHERE side=0) b FULL JOIN (SELECT * FROM s WHERE side=1 AND NOT (model_id='m1' AND task_name='view')) c ON b.task_name=c.task_name AND b.model_id=c.model_id AND b.prompt_version=c.prompt_version""", ("v_results",))
def jn_baseline(t: Tables):
    """The first half of the month as the baseline run, the rest as the current one; each lacks one group."""
    scored = t.results.select(
        "ts", "task_name", "prompt_version", "model_id", F.lit("v1").alias("scorer_version"), F.col("task_metrics")[0]["value"].alias("acc")
    )
    def run(rows):
        return rows.groupBy(*C.BASELINE_KEYS).agg(F.round(F.avg("acc"), 4).alias("primary_score")).withColumn("primary_metric", F.lit("acc"))
    early = scored.where("ts < timestamp '2024-01-16' and not (model_id = 'm2' and task_name = 'click')")
    late = scored.where("ts >= timestamp '2024-01-16' and not (model_id = 'm1' and task_name = 'view')")
    out = C.compare_runs(run(early), run(late))
    return out.select("task_name", "model_id", "baseline_score", "current_score", "delta", "regressed", "side")


@query("jn_isin_semi", _sql_tops("SELECT symbol, name FROM r WHERE symbol IN (SELECT symbol FROM ts) AND name IN (SELECT name FROM tn)"), ("v_stocks", "v_derived"))
def jn_isin_semi(t: Tables):
    rows = G.name_join(K.core_only(t.stocks).select("plate_id", "symbol"), t.derived, ["name"]).select("symbol", "name")
    top_s = nlargest(A.distinct_counts(rows, ["symbol"], {"n": "name"}), 20, "n", "symbol").select("symbol")
    top_n = nlargest(A.value_counts(rows, "name", "n"), 20, "n", "name").select("name")
    return rows.join(top_s, "symbol", "left_semi").join(top_n, "name", "left_semi").select("symbol", "name")


@query("jn_payload_resume", "SELECT p_partkey id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>45)")
def jn_payload_resume(t: Tables):
    stored = t.table("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return G.ids_to_load(t.table("part").select(F.col("p_partkey").alias("id")), stored, "id")


_TYPES = ["choice", "number", "list", "text", "reasoning", "essay"]


@query("jn_preset", f"""SELECT doc_id, [{",".join(repr(x) for x in _TYPES)}][(doc_id%6+1)::INT] answer_type, ['exact_match','within_tol','f1','rouge1','final_answer_acc',NULL][(doc_id%6+1)::INT] primary_metric,
 [0.5,0.5,0.5,0.3,0.5,NULL][(doc_id%6+1)::INT]::DOUBLE pass_threshold FROM documents""")
def jn_preset(t: Tables):
    rows = t.table("documents").select("doc_id", nth(_TYPES, F.col("doc_id") % 6).alias("answer_type"))
    return C.join_presets(rows).select("doc_id", "answer_type", "primary_metric", "pass_threshold")


@query("fn_append_error", "SELECT event_id, CASE WHEN error='' THEN 'parse_error: x' ELSE error||'; parse_error: x' END error FROM v_results", ("v_results",))
def fn_append_error(t: Tables):
    return t.results.select("event_id", append_error(F.col("error"), F.lit("parse_error: x")).alias("error"))
