"""Aggregations, scaling, order statistics, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import aggregates as A
from scorelake.operators import checks as K
from scorelake.operators import grid as G
from scorelake.operators import ranking as R
from scorelake.operators import workflow as W
from scorelake.operators.metrics import overlap_counts, union_evidence
from scorelake.operators.order_stats import upper_median, values_at_ranks
from scorelake.plans import plates as PL
from scorelake.plans import reports as REP
from scorelake.plans.adapters import Tables
from scorelake.plans.registry import query
from scorelake.session import stored_once
from scorelake.plans.queries_rows import ASSOCIATION, PLATE_VIEWS, _sql_tops
from scorelake.functions.outputs import parse_outputs

_RATE = "round(coalesce(count(*) FILTER (parse_applicable AND parse_success)::DOUBLE/nullif(count(*) FILTER (parse_applicable),0),0.0),4)"
SUMMARY = f"""SELECT 'summary_row.v1' schema_version, task_name, model_id, step_id, count(*) request_count, count(*) FILTER (success) success_count,
 round(count(*) FILTER (success)/count(*)::DOUBLE,4) success_rate, round(sum(latency_ms::DECIMAL(38,10))::DOUBLE/count(*),2) avg_latency_ms,
 round(quantile_disc(latency_ms,0.95),2) p95_latency_ms, round(sum(total_tokens)::DOUBLE/count(*),2) avg_total_tokens,
 round(quantile_disc(total_tokens::DOUBLE,0.95),2) p95_total_tokens, {_RATE} parse_rate, sum(retry_count)::BIGINT retry_count,
 round(sum(cost_estimate::DECIMAL(38,10))::DOUBLE,6) cost_estimate FROM v_costed GROUP BY task_name, model_id, step_id"""


@query("agg_summary", SUMMARY, ("v_costed",))
def agg_summary(t: Tables):
    return A.summarize(t.costed)


@query("agg_p95", "SELECT sample_id, quantile_disc(latency_ms,0.95) p95 FROM v_results GROUP BY 1", ("v_results",))
def agg_p95(t: Tables):
    return A.p95(t.results, ["sample_id"], F.col("latency_ms"), "p95")


_TM = """SELECT task_name, model_id, step_id, 'acc' metric, round(sum(m_acc::DECIMAL(38,10))::DOUBLE/count(m_acc),4) avg_value FROM v_results GROUP BY 1,2,3
 UNION ALL SELECT task_name, model_id, step_id, 'gap', round(sum(m_gap::DECIMAL(38,10))::DOUBLE/nullif(count(m_gap),0),4) FROM v_results GROUP BY 1,2,3"""


@query("agg_task_metrics", _TM, ("v_results",))
def agg_task_metrics(t: Tables):
    return A.task_metric_averages(t.results)


_FAILED = "(NOT success OR (parse_applicable AND NOT parse_success))"


@query("agg_error_types", f"SELECT coalesce(nullif(error_type,''),'unknown_error') error_type, count(*) AS \"count\" FROM v_results WHERE {_FAILED} GROUP BY 1", ("v_results",))
def agg_error_types(t: Tables):
    return A.error_type_counts(t.results)


_WF = f"""SELECT workflow_name, workflow_version, mode, model_id, count(*) request_count, round(count(*) FILTER (success)/count(*)::DOUBLE,4) success_rate, {_RATE} parse_rate,
 round(sum(latency_ms::DECIMAL(38,10))::DOUBLE/count(*),2) avg_latency_ms, round(sum(cost_estimate::DECIMAL(38,10))::DOUBLE,6) cost_estimate
 FROM v_costed WHERE mode<>'task' GROUP BY 1,2,3,4"""


@query("agg_workflow", _WF, ("v_costed",))
def agg_workflow(t: Tables):
    return A.workflow_summary(t.costed)


_E2E = """SELECT sample_id, workflow_name, bool_and(executed AND success AND (parse_success OR NOT parse_applicable)) success,
 coalesce(arg_max(parse_applicable, ord) FILTER (executed), true) parse_applicable,
 (list(CASE WHEN executed THEN parsed END ORDER BY ord DESC))[1] parsed,
 round(coalesce(sum(latency_ms::DECIMAL(38,10)) FILTER (executed)::DOUBLE,0),2) latency_ms, coalesce(sum(total_tokens) FILTER (executed),0)::BIGINT total_tokens,
 coalesce(sum(retry_count) FILTER (executed),0)::BIGINT retry_count, round(coalesce(sum(cost_estimate::DECIMAL(38,10)) FILTER (executed)::DOUBLE,0),8) cost_estimate FROM v_steps GROUP BY 1,2"""


@query("agg_e2e", f"""SELECT e.*, parse_applicable AND parsed IS NOT NULL parse_success, CASE WHEN success THEN '' ELSE 'workflow_step_failed' END error, l.model_id FROM ({_E2E}) e
 JOIN (SELECT workflow_name, string_agg(model_id,'+' ORDER BY ord) model_id FROM (SELECT DISTINCT workflow_name, ord, model_id FROM v_steps) GROUP BY 1) l USING (workflow_name)""", ("v_steps",))
def agg_e2e(t: Tables):
    whole = W.end_to_end(t.steps, ["sample_id", "workflow_name"])
    labels = W.model_labels(t.steps).withColumnRenamed("model_label", "model_id")
    return whole.join(labels, "workflow_name").select(
        "sample_id", "workflow_name", "success", "parse_applicable", "parsed", "latency_ms", "total_tokens", "retry_count",
        "cost_estimate", "parse_success", "error", "model_id",
    )


@query("agg_batch_stats", """SELECT model_id, count(*) total, count(*) FILTER (success) success_count, sum(prompt_tokens) FILTER (success)::BIGINT input_tokens, sum(completion_tokens) FILTER (success)::BIGINT output_tokens,
 round(sum(latency_ms::DECIMAL(38,10)) FILTER (success AND latency_ms>0)::DOUBLE/count(*) FILTER (success AND latency_ms>0),4) avg_ms, median(latency_ms) FILTER (success AND latency_ms>0) p50_ms,
 list_sort(list(latency_ms) FILTER (success AND latency_ms>0))[(least(floor(count(*) FILTER (success AND latency_ms>0)*0.99)+1, count(*) FILTER (success AND latency_ms>0)))::INT] p99_ms,
 min(latency_ms) FILTER (success AND latency_ms>0) min_ms, max(latency_ms) FILTER (success AND latency_ms>0) max_ms FROM v_results GROUP BY 1""", ("v_results",))
def agg_batch_stats(t: Tables):
    return A.batch_stats(t.results, ["model_id"])


_F1 = "CASE WHEN pr+rc>0 THEN 2*pr*rc/(pr+rc) ELSE 0.0::DOUBLE END"


def _overlap(t: Tables):
    rows = t.pair_list.select("l_orderkey", F.transform("parsed.items", F.lower).alias("p"), F.transform("sample.items", F.lower).alias("t"))
    return overlap_counts(rows, F.col("p"), F.col("t")).withColumn("model_id", F.concat(F.lit("m"), (F.col("l_orderkey") % 4).cast("string")))


@query("agg_overlap_stats", f"""SELECT 'm'||(l_orderkey%4) model_id, count(*) samples, round(sum(f1::DECIMAL(38,10))::DOUBLE/count(*),6) avg_f1, max(f1) max_f1, min(f1) min_f1,
 round(sum(pr::DECIMAL(38,10))::DOUBLE/count(*),6) avg_precision, round(sum(rc::DECIMAL(38,10))::DOUBLE/count(*),6) avg_recall, list_sort(list(f1))[(count(*)//2+1)::INT] median_f1
 FROM (SELECT *, {_F1} f1 FROM v_list_scores) GROUP BY 1""", ("v_list_scores",))
def agg_overlap_stats(t: Tables):
    return A.overlap_stats(_overlap(t), ["model_id"])


@query("agg_core_count", """SELECT p.id, p.name, p."desc", sum((core_flag=100)::INT)::BIGINT core_count, count(symbol) total_count FROM v_plates p JOIN v_stocks s ON p.id=s.plate_id GROUP BY ALL HAVING sum((core_flag=100)::INT) BETWEEN 5 AND 50""", ("v_plates", "v_stocks"))
def agg_core_count(t: Tables):
    return PL.core_counts(t.plates, t.stocks)


@query("agg_group_size", "SELECT plate_id, count(*) stock_count FROM v_stocks GROUP BY 1", ("v_stocks",))
def agg_group_size(t: Tables):
    return A.group_sizes(t.stocks, ["plate_id"], "stock_count")


@query("agg_group_size_chains", "SELECT c.plate_id, d.name, count(*) chain_count FROM v_chains c JOIN v_derived d ON c.plate_id=d.id GROUP BY 1,2", ("v_chains", "v_derived"))
def agg_group_size_chains(t: Tables):
    return PL.chains_per_plate(t.chains, t.derived)


@query("agg_nunique", "SELECT symbol, count(DISTINCT plate_id) plate_count FROM v_stocks GROUP BY 1", ("v_stocks",))
def agg_nunique(t: Tables):
    return PL.plates_per_stock(t.stocks)


@query("agg_nunique_chains", "SELECT count(DISTINCT chain_id) chains, count(DISTINCT plate_id) plates FROM v_chains", ("v_chains",))
def agg_nunique_chains(t: Tables):
    return A.distinct_counts(t.chains, [], {"chains": "chain_id", "plates": "plate_id"})


_LEADER = """SELECT symbol, count(DISTINCT plate_id) plate_count, sum(avg_pcp_pct::DECIMAL(38,12))::DOUBLE/nullif(count(avg_pcp_pct),0) avg_plate_pcp, coalesce(sum(fund_flow_yi::DECIMAL(38,12))::DOUBLE,0.0) total_fund_flow,
 array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL))[1:5],', ') plates FROM v_stocks s LEFT JOIN v_derived d ON s.plate_id=d.id WHERE core_flag=100 GROUP BY 1"""


@query("agg_leader", f"SELECT symbol, plate_count, round(avg_plate_pcp,9) avg_plate_pcp, round(total_fund_flow,9) total_fund_flow, plates FROM ({_LEADER})", ("v_stocks", "v_derived"))
def agg_leader(t: Tables):
    pairs = stored_once(PL.core_pairs(t.stocks, t.derived), "core-pairs")
    return PL.with_plate_names(PL.leader_measures(pairs), pairs).select(
        "symbol", "plate_count", F.round("avg_plate_pcp", 9).alias("avg_plate_pcp"), F.round("total_fund_flow", 9).alias("total_fund_flow"), "plates"
    )


@query("agg_value_counts", "SELECT core_flag, count(*) n FROM v_stocks WHERE core_flag IS NOT NULL GROUP BY 1", ("v_stocks",))
def agg_value_counts(t: Tables):
    return A.value_counts(t.stocks, "core_flag", "n")


_DESC_COLS = ["avg_pcp", "core_avg_pcp", "rise_count", "fund_flow_yi", "core_stocks_count"]


@query("agg_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", round(sum({c}::DECIMAL(38,10))::DOUBLE/count({c}),6) mean, round(stddev_samp({c}),6) std, min({c})::DOUBLE AS "min",
 round(quantile_cont({c}::DOUBLE,0.25),6) p25, round(quantile_cont({c}::DOUBLE,0.5),6) p50, round(quantile_cont({c}::DOUBLE,0.75),6) p75, max({c})::DOUBLE AS "max" FROM v_derived"""
    for c in _DESC_COLS), ("v_derived",))
def agg_describe(t: Tables):
    return A.describe(t.derived, _DESC_COLS)


_NULLS = ["id", "name", "avg_pcp", "core_avg_pcp", "fund_flow", "updated_at", "rise_ratio"]


@query("agg_null_counts", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) nulls FROM v_derived""" for c in _NULLS), ("v_derived",))
def agg_null_counts(t: Tables):
    return A.null_counts(t.derived.select(*_NULLS))


def _hist_sql(column: str, source: str, bins: int) -> str:
    return f"""SELECT b.bin::INTEGER bin, coalesce(c.n,0)::BIGINT n FROM (SELECT unnest(range(0,{bins})) bin) b LEFT JOIN (
 SELECT least(floor(({column}-lo)/w), {bins - 1})::INTEGER bin, count(*) n FROM {source}, (SELECT min({column}) lo, (max({column})-min({column}))::DOUBLE/{bins} w FROM {source}) WHERE {column} IS NOT NULL GROUP BY 1) c USING (bin)"""


@query("agg_histogram", _hist_sql("avg_pcp_pct", "v_derived", 60), ("v_derived",))
def agg_histogram(t: Tables):
    return A.histogram(t.derived, "avg_pcp_pct", 60)


@query("agg_histogram_latency", _hist_sql("latency_ms", "v_results", 50), ("v_results",))
def agg_histogram_latency(t: Tables):
    return A.histogram(t.results, "latency_ms", 50)


@query("agg_histogram_ratio", _hist_sql("core_ratio", "v_derived", 40), ("v_derived",))
def agg_histogram_ratio(t: Tables):
    return A.histogram(K.drop_nulls(t.derived, "core_ratio"), "core_ratio", 40)


@query("agg_histogram_integer", "SELECT plate_count::BIGINT bin, count(*) n FROM (SELECT symbol, count(DISTINCT plate_id) plate_count FROM v_stocks GROUP BY 1) GROUP BY 1", ("v_stocks",))
def agg_histogram_integer(t: Tables):
    return A.integer_histogram(PL.plates_per_stock(t.stocks), "plate_count")


@query("agg_median", "SELECT median(latency_ms) latency_ms, median(total_tokens)::DOUBLE total_tokens FROM v_results", ("v_results",))
def agg_median(t: Tables):
    return A.column_medians(t.results, {"latency_ms": F.col("latency_ms"), "total_tokens": F.col("total_tokens")})


@query("agg_crosstab", _sql_tops("""SELECT s.symbol, n.name, count(r.symbol) n FROM (SELECT DISTINCT symbol FROM r WHERE symbol IN (SELECT symbol FROM ts) AND name IN (SELECT name FROM tn)) s
 CROSS JOIN (SELECT DISTINCT name FROM r WHERE symbol IN (SELECT symbol FROM ts) AND name IN (SELECT name FROM tn)) n LEFT JOIN r ON r.symbol=s.symbol AND r.name=n.name GROUP BY 1,2"""), ("v_stocks", "v_derived"))
def agg_crosstab(t: Tables):
    return PL.core_matrix(t.stocks, t.derived)


@query("agg_crosstab_wide", "SELECT task_name, count(*) FILTER (model_id='m0') m0, count(*) FILTER (model_id='m1') m1, count(*) FILTER (model_id='mx') mx FROM v_results GROUP BY 1", ("v_results",))
def agg_crosstab_wide(t: Tables):
    return A.crosstab(t.results, "task_name", "model_id", ["m0", "m1", "mx"])


@query("agg_sign_counts", """SELECT count(*) FILTER (avg_pcp_pct>0) up, count(*) FILTER (avg_pcp_pct<0) down, count(*) FILTER (avg_pcp_pct=0) flat,
 round(count(*) FILTER (avg_pcp_pct>0)/count(*)::DOUBLE*100,1) up_pct, round(count(*) FILTER (avg_pcp_pct<0)/count(*)::DOUBLE*100,1) down_pct FROM v_derived""", ("v_derived",))
def agg_sign_counts(t: Tables):
    return A.sign_counts(t.derived, "avg_pcp_pct")


@query("agg_range", "SELECT min(avg_pcp_pct) avg_pcp_pct_min, max(avg_pcp_pct) avg_pcp_pct_max, min(fund_flow_yi) fund_flow_yi_min, max(fund_flow_yi) fund_flow_yi_max FROM v_derived", ("v_derived",))
def agg_range(t: Tables):
    return A.value_range(t.derived, ["avg_pcp_pct", "fund_flow_yi"])


@query("agg_dataset_stats", f"""SELECT count(*) samples, min(core_stocks_count)::INTEGER min_core, max(core_stocks_count)::INTEGER max_core, round(avg(core_stocks_count),1) avg_core, count(*) FILTER (chains<>'') with_chains,
 count(plate_intro) with_intro FROM ({ASSOCIATION})""", PLATE_VIEWS)
def agg_dataset_stats(t: Tables):
    return A.dataset_stats(PL.association_set(t.plates, t.stocks, t.chains, t.answers))


@query("agg_dataset_skipped", """SELECT count(*) skipped FROM (SELECT p.id FROM v_plates p JOIN v_stocks s ON p.id=s.plate_id WHERE length(trim("desc"))<10 GROUP BY 1 HAVING sum((core_flag=100)::INT) BETWEEN 5 AND 50)""", ("v_plates", "v_stocks"))
def agg_dataset_skipped(t: Tables):
    return PL.skipped_plates(t.plates, t.stocks)


@query("agg_table_counts", """SELECT 'plates' AS "table", count(*) AS "rows" FROM v_plates UNION ALL SELECT 'stocks', count(*) FROM v_stocks UNION ALL SELECT 'industrial_chains', count(*) FROM v_chains UNION ALL SELECT 'question_answers', count(*) FROM v_qa""", PLATE_VIEWS)
def agg_table_counts(t: Tables):
    return A.table_counts({"plates": t.plates, "stocks": t.stocks, "industrial_chains": t.chains, "question_answers": t.answers})


@query("agg_ingest_outcome", "SELECT count(*) FILTER (p_partkey%10<>0) success, count(*) FILTER (p_partkey%10=0) fail FROM part")
def agg_ingest_outcome(t: Tables):
    log = t.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10 != 0).alias("ok"))
    return A.ingest_outcome(log)


@query("agg_ingest_failed", "SELECT p_partkey id FROM part WHERE p_partkey%10=0")
def agg_ingest_failed(t: Tables):
    return A.failed_ids(t.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10 != 0).alias("ok")), "id")


@query("agg_parse_outcome", """SELECT reason, strategy, count(*) AS "rows" FROM (SELECT ['ok','ok','ok','ok','ok','truncated','empty'][(doc_id%7+1)::INT] reason,
 ['full_text','fenced_block','full_text','full_text','balanced_extract','balanced_extract','none'][(doc_id%7+1)::INT] strategy FROM documents) GROUP BY 1,2""")
def agg_parse_outcome(t: Tables):
    return A.parse_outcomes(parse_outputs(t.outputs.select("doc_id", "output_text")))


# --- scaling and order statistics ------------------------------------------------------------------------

def _scale_sql(column: str, source: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN (SELECT max({column})=min({column}) FROM {source}) THEN 0.0 ELSE ({column}-(SELECT min({column}) FROM {source}))::DOUBLE/(SELECT max({column})-min({column}) FROM {source})::DOUBLE END"


@query("win_minmax", f"SELECT id, {_scale_sql('fund_flow_yi', 'v_derived')} s_fund, {_scale_sql('core_stocks_count', 'v_derived')} s_core FROM v_derived", ("v_derived",))
def win_minmax(t: Tables):
    return R.min_max_scale(t.derived.select("id", "fund_flow_yi", "core_stocks_count"), {"s_fund": "fund_flow_yi", "s_core": "core_stocks_count"}).select("id", "s_fund", "s_core")


_HEAT = f""", b AS (SELECT id, name, fund_flow_yi, rise_ratio, core_stocks_count FROM v_derived WHERE fund_flow_yi IS NOT NULL AND rise_ratio IS NOT NULL),
 h AS (SELECT *, s_fund*0.4::DOUBLE+s_rise*0.35::DOUBLE+s_core*0.25::DOUBLE heat_score FROM (SELECT *, {_scale_sql('fund_flow_yi', 'b')} s_fund, {_scale_sql('rise_ratio', 'b')} s_rise, {_scale_sql('core_stocks_count', 'b')} s_core FROM b)) """


@query("win_weighted_score", _HEAT + "SELECT id, round(heat_score,9) heat_score FROM h", ("v_derived",))
def win_weighted_score(t: Tables):
    return PL.heat_scores(t.derived).select("id", F.round("heat_score", 9).alias("heat_score"))


@query("win_nth", "SELECT task_name, list_sort(list(latency_ms))[(count(*)//2+1)::INT] upper_median, list_sort(list(latency_ms))[least(floor(count(*)*0.99)+1,count(*))::INT] p99 FROM v_results GROUP BY 1", ("v_results",))
def win_nth(t: Tables):
    from scorelake.operators.order_stats import floor_rank

    x = F.col("latency_ms")
    return values_at_ranks(t.results, ["task_name"], {"upper_median": (x, upper_median), "p99": (x, floor_rank("0.99"))})


def _log_lines(t: Tables):
    i, c = F.col("event_id"), F.concat
    good = c(F.lit("INFO ["), i.cast("string"), F.lit("/9000000] plate "), "event_type", F.lit("(id="), "user_id", F.lit(") 成分股="), (i % 90).cast("string"))
    bad = c(F.lit("ERROR ["), i.cast("string"), F.lit("/9000000] 失败 id="), F.col("user_id").cast("string"), F.lit(": boom"))
    line = F.when(i % 5 == 0, bad).when(i % 7 == 0, F.lit("noise")).otherwise(good)
    return t.table("events").select("event_type", i.alias("line_no"), line.alias("line"))


_LOG = """SELECT event_type, arg_max(event_id, event_id) FILTER (event_id%5<>0 AND event_id%7<>0) cur, count(*) FILTER (event_id%5<>0 AND event_id%7<>0) success, count(*) FILTER (event_id%5=0) fail FROM events GROUP BY 1"""


@query("win_last_progress", f"""SELECT event_type, cur AS "current", 9000000::BIGINT total, 'plate '||event_type latest_plate, cur%90 stock_count, success, fail, round(cur/9000000.0::DOUBLE*100,1) percent,
 CASE WHEN floor(600.0::DOUBLE/cur*(9000000-cur)/60)>60 THEN (floor(floor(600.0::DOUBLE/cur*(9000000-cur)/60)/60))::BIGINT||'h '||(floor(600.0::DOUBLE/cur*(9000000-cur)/60)%60)::BIGINT||'m'
  ELSE floor(600.0::DOUBLE/cur*(9000000-cur)/60)::BIGINT||'m '||floor((600.0::DOUBLE/cur*(9000000-cur))%60)::BIGINT||'s' END eta FROM ({_LOG})""")
def win_last_progress(t: Tables):
    return R.with_eta(R.last_progress(_log_lines(t), ["event_type"]), F.lit(600.0))


@query("win_latest_payload", "SELECT user_id, event_type, ts_text, value FROM (SELECT user_id, event_type, strftime(ts,'%Y-%m-%d %H:%M:%S.%f') ts_text, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn=1")
def win_latest_payload(t: Tables):
    rows = t.table("events").select("user_id", "ts", "event_id", "event_type", "value")
    newest = R.latest_per_key(rows, ["user_id"], F.col("ts"), F.col("event_id"))
    return newest.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "value")


# --- sorts and top-k -------------------------------------------------------------------------------------

_ODD = """SELECT task_name, model_id, m AS metric, v FROM (SELECT task_name, model_id, event_id, CASE event_id%11 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 1e-12::DOUBLE ELSE m_acc END v, 'acc' m FROM v_results)"""


@query("agg_task_metrics_odd", f"SELECT task_name, model_id, metric, round(avg(v) FILTER (isfinite(v)),4) avg_value FROM ({_ODD}) GROUP BY 1,2,3", ("v_results",))
def agg_task_metrics_odd(t: Tables):
    """Infinite and NaN metric values are left out of the mean, tiny ones are not lost."""
    i, own = F.col("event_id") % 11, F.col("task_metrics")[0]["value"]
    odd = F.when(i == 0, F.lit(float("inf"))).when(i == 1, F.lit(float("nan"))).when(i == 2, F.lit(1e-12)).otherwise(own)
    rows = t.results.withColumn("task_metrics", F.array(F.struct(F.lit("acc").alias("name"), odd.alias("value"))))
    return A.task_metric_averages(rows).select("task_name", "model_id", "metric", "avg_value")


@query("agg_summary_odd", """SELECT task_name, model_id, count(*) request_count, coalesce(round(sum(l::DECIMAL(38,10)) FILTER (isfinite(l))::DOUBLE/count(*) FILTER (isfinite(l)),2),0) avg_latency_ms FROM (
 SELECT task_name, model_id, CASE event_id%7 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE ELSE latency_ms END l FROM v_results) GROUP BY 1,2""".replace("sum(l::DECIMAL(38,10)) FILTER (isfinite(l))", "sum(CASE WHEN isfinite(l) THEN l END::DECIMAL(38,10))"), ("v_results",))
def agg_summary_odd(t: Tables):
    i = F.col("event_id") % 7
    odd = F.when(i == 0, F.lit(float("inf"))).when(i == 1, F.lit(float("nan"))).otherwise(F.col("latency_ms"))
    return A.summarize(t.results.withColumn("latency_ms", odd)).select("task_name", "model_id", "request_count", "avg_latency_ms")


@query("srt_summary", f"SELECT task_name, step_id, model_id, request_count, cost_estimate FROM ({SUMMARY}) ORDER BY 1,2,3", ("v_costed",))
def srt_summary(t: Tables):
    return A.sort_summary(A.summarize(t.costed)).select("task_name", "step_id", "model_id", "request_count", "cost_estimate")


@query("srt_workflow", f"SELECT * FROM ({_WF}) ORDER BY 1,2,3,4", ("v_costed",))
def srt_workflow(t: Tables):
    return A.workflow_summary(t.costed).orderBy("workflow_name", "workflow_version", "mode", "model_id")


_COMPARE = f"""SELECT s.task_name, s.model_id, s.success_rate, s.parse_rate, s.avg_latency_ms, s.cost_estimate, a.avg_value tm_acc_avg, g.avg_value tm_gap_avg FROM ({SUMMARY}) s
 LEFT JOIN (SELECT * FROM ({_TM}) WHERE metric='acc') a USING (task_name, model_id, step_id) LEFT JOIN (SELECT * FROM ({_TM}) WHERE metric='gap') g USING (task_name, model_id, step_id)"""


def _compare(t: Tables):
    wide = A.wide_metrics(A.task_metric_averages(t.costed), ["acc", "gap"])
    return REP.task_compare(A.summarize(t.costed), wide)


@query("srt_task_compare", _COMPARE + " ORDER BY 1,2", ("v_costed",))
def srt_task_compare(t: Tables):
    return _compare(t)


_TOP5 = f"""SELECT sample_id, task_name, step_id, model_id, error_type, error, left(output_text,180) output_excerpt FROM v_results WHERE {_FAILED} ORDER BY "timestamp", sample_id, step_id, model_id, repeat_idx LIMIT 5"""
_CASE_COLS = ["sample_id", "task_name", "step_id", "model_id", "error_type", "error", "output_excerpt"]


@query("top_failures", _TOP5, ("v_results",))
def top_failures(t: Tables):
    return R.top_failures(A.failed_rows(t.results)).select(*_CASE_COLS)


_F1_ROWS = f"SELECT l_orderkey, np::INTEGER pred_count, nt::INTEGER gt_count, ni::INTEGER match_count, pr \"precision\", rc recall, {_F1} f1 FROM v_list_scores"
_F1_COLS = ["l_orderkey", "pred_count", "gt_count", "match_count", "precision", "recall", "f1"]


@query("top_f1", f"SELECT * FROM ({_F1_ROWS}) ORDER BY f1 DESC, l_orderkey LIMIT 10", ("v_list_scores",))
def top_f1(t: Tables):
    return R.nlargest(_overlap(t).select(*_F1_COLS), 10, "f1", "l_orderkey")


@query("bottom_f1", f"SELECT * FROM ({_F1_ROWS}) ORDER BY f1, l_orderkey LIMIT 5", ("v_list_scores",))
def bottom_f1(t: Tables):
    return R.nsmallest(_overlap(t).select(*_F1_COLS), 5, "f1", "l_orderkey")


@query("top_nlargest", "SELECT id, name, fund_flow_yi FROM v_derived ORDER BY fund_flow_yi DESC NULLS LAST, id LIMIT 20", ("v_derived",))
def top_nlargest(t: Tables):
    return R.nlargest(t.derived.select("id", "name", "fund_flow_yi"), 20, "fund_flow_yi", "id")


@query("top_nsmallest", "SELECT id, name, avg_pcp_pct FROM v_derived ORDER BY avg_pcp_pct ASC NULLS LAST, id LIMIT 20", ("v_derived",))
def top_nsmallest(t: Tables):
    return R.nsmallest(t.derived.select("id", "name", "avg_pcp_pct"), 20, "avg_pcp_pct", "id")


@query("top_index_keys", _sql_tops("SELECT 'symbol' kind, symbol AS key FROM ts UNION ALL SELECT 'name', name FROM tn"), ("v_stocks", "v_derived"))
def top_index_keys(t: Tables):
    rows = G.name_join(K.core_only(t.stocks).select("plate_id", "symbol"), t.derived, ["name"])
    symbols = R.nlargest(A.distinct_counts(rows, ["symbol"], {"n": "name"}), 20, "n", "symbol")
    names = R.nlargest(A.value_counts(rows, "name", "n"), 20, "n", "name")
    return symbols.select(F.lit("symbol").alias("kind"), F.col("symbol").alias("key")).unionByName(
        names.select(F.lit("name").alias("kind"), F.col("name").alias("key"))
    )


@query("srt_children", """SELECT plate_id, string_agg(name,',' ORDER BY "order") chains FROM v_chains GROUP BY 1""", ("v_chains",))
def srt_children(t: Tables):
    return R.ordered_children(t.chains, "plate_id", "name", ["order", "chain_id"], "c").select("plate_id", F.array_join("c", ",").alias("chains"))


@query("lim_first", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) rn FROM events) WHERE rn=1")
def lim_first(t: Tables):
    return R.first_per_key(t.table("events").select("user_id", "event_id", "value"), ["user_id"], F.col("value"), F.col("event_id"))


@query("lim_rows", "SELECT news_id, news_title FROM v_news WHERE news_body<>'' AND news_summary<>'' ORDER BY news_id LIMIT 100", ("v_news",))
def lim_rows(t: Tables):
    from scorelake.sources.readers import select_news

    return select_news(t.news, 100).select("news_id", "news_title")


@query("lim_preview", "SELECT id, name FROM v_derived ORDER BY id LIMIT 3", ("v_derived",))
def lim_preview(t: Tables):
    return R.first_rows(t.derived.select("id", "name"), 3, "id")


# --- set operations --------------------------------------------------------------------------------------

@query("set_intersect_rows", "SELECT l_orderkey, np::INTEGER pred_count, nt::INTEGER gt_count, ni::INTEGER match_count FROM v_list_counts WHERE np>0 OR nt>0", ("v_list_counts",))
def set_intersect_rows(t: Tables):
    """One row per item on both sides: nothing is put into lists."""
    from scorelake.operators.metrics import overlap_counts_long

    li = t.table("lineitem").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select("l_orderkey", F.concat(F.lit("item "), (F.col("p_size") % 10).cast("string")).alias("item"), "l_returnflag")
    out = overlap_counts_long(rows.where("l_returnflag in ('R', 'N')"), rows.where("l_returnflag in ('A', 'N')"), ["l_orderkey"], "item")
    return out.select("l_orderkey", *[F.col(c).cast("int").alias(c) for c in ("pred_count", "gt_count", "match_count")])


@query("set_union_evidence", "SELECT doc_id, array_to_string(list_sort(list_distinct([lower(source), lower(lang), (doc_id%5)::VARCHAR])),',') ids FROM documents")
def set_union_evidence(t: Tables):
    rows = t.pair_reason
    claims = rows.schema["parsed"].dataType["claims"].dataType
    ids = union_evidence(F.col("parsed.claims"), claims, "evidence", True)
    return rows.select("doc_id", F.array_join(F.array_sort(ids), ",").alias("ids"))


@query("set_except_todo", "SELECT p_partkey id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>48)")
def set_except_todo(t: Tables):
    stored = t.table("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id"))
    return G.ids_to_load(t.table("part").select(F.col("p_partkey").alias("id")), stored, "id")


@query("set_union_rows", """SELECT sample_id, step_id, model_id, success, retry_count, error FROM (SELECT sample_id, step_id, model_id, success, retry_count::BIGINT retry_count, NULL error FROM v_steps
 UNION ALL SELECT sample_id, '__e2e__', NULL, bool_and(executed AND success AND (parse_success OR NOT parse_applicable)), coalesce(sum(retry_count) FILTER (executed),0)::BIGINT,
 CASE WHEN bool_and(executed AND success AND (parse_success OR NOT parse_applicable)) THEN '' ELSE 'workflow_step_failed' END FROM v_steps GROUP BY 1)""", ("v_steps",))
def set_union_rows(t: Tables):
    steps = t.steps.select("sample_id", "step_id", "model_id", "success", F.col("retry_count").cast("bigint").alias("retry_count"))
    whole = W.end_to_end(t.steps, ["sample_id"]).select("sample_id", "step_id", "success", "retry_count", "error")
    return steps.unionByName(whole, allowMissingColumns=True).select("sample_id", "step_id", "model_id", "success", "retry_count", "error")


@query("set_distinct_keys", "SELECT DISTINCT sample_id, task_name, step_id, model_id, (event_id%3)::INTEGER repeat_idx FROM v_results", ("v_results",))
def set_distinct_keys(t: Tables):
    return G.completed_keys(t.results.withColumn("repeat_idx", F.col("event_id") % 3))


# --- reports ---------------------------------------------------------------------------------------------

@query("rep_overview", f"SELECT task_name, model_id, request_count, success_rate, parse_rate, avg_latency_ms, avg_total_tokens, cost_estimate FROM ({SUMMARY})", ("v_costed",))
def rep_overview(t: Tables):
    return REP.overview(A.summarize(t.costed))


@query("rep_task_compare", _COMPARE, ("v_costed",))
def rep_task_compare(t: Tables):
    return _compare(t)


@query("rep_failures", f"""SELECT error_type AS kind, n::VARCHAR AS detail FROM (SELECT coalesce(nullif(error_type,''),'unknown_error') error_type, count(*) n FROM v_results WHERE {_FAILED} GROUP BY 1)
 UNION ALL SELECT 'case', sample_id||'/'||task_name||'/'||model_id||'/'||error FROM ({_TOP5})""", ("v_results",))
def rep_failures(t: Tables):
    parts = REP.failures(t.results)
    cases = parts["cases"].select(F.lit("case").alias("kind"), F.concat_ws("/", "sample_id", "task_name", "model_id", "error").alias("detail"))
    return parts["types"].select(F.col("error_type").alias("kind"), F.col("count").cast("string").alias("detail")).unionByName(cases)


@query("rep_heat", _HEAT + "SELECT id, name, round(s_fund,9) s_fund, round(s_rise,9) s_rise, round(s_core,9) s_core, round(heat_score,9) heat_score FROM h ORDER BY h.heat_score DESC, id LIMIT 30", ("v_derived",))
def rep_heat(t: Tables):
    top = R.nlargest(PL.heat_scores(t.derived), 30, "heat_score", "id")
    return top.select("id", "name", *[F.round(c, 9).alias(c) for c in ("s_fund", "s_rise", "s_core", "heat_score")])


_LEAD = f""", a AS ({_LEADER}), z AS (SELECT *, round(s_cross*0.3::DOUBLE+s_pcp*0.4::DOUBLE+s_fund*0.3::DOUBLE,9) leader_score FROM (SELECT *, {_scale_sql('plate_count', 'a')} s_cross, {_scale_sql('avg_plate_pcp', 'a')} s_pcp, {_scale_sql('total_fund_flow', 'a')} s_fund FROM a)) """


@query("rep_leader", _LEAD + "SELECT symbol, leader_score, plate_count, plates FROM z ORDER BY leader_score DESC NULLS LAST, symbol LIMIT 50", ("v_stocks", "v_derived"))
def rep_leader(t: Tables):
    pairs = stored_once(PL.core_pairs(t.stocks, t.derived), "core-pairs")
    scored = PL.leader_scores(stored_once(PL.leader_measures(pairs), "leader-measures")).withColumn("leader_score", F.round("leader_score", 9))
    top = R.nlargest(scored, 50, "leader_score", "symbol")
    return PL.with_plate_names(top, pairs).select("symbol", "leader_score", "plate_count", "plates")


@query("rep_core_vs_all", """SELECT id, avg_pcp_pct, core_avg_pcp_pct, fund_flow_yi, greatest(5,least(200,total_stocks))::BIGINT marker_size FROM v_derived WHERE avg_pcp_pct IS NOT NULL AND core_avg_pcp_pct IS NOT NULL""", ("v_derived",))
def rep_core_vs_all(t: Tables):
    return PL.core_vs_all(t.derived).withColumn("marker_size", F.col("marker_size").cast("bigint"))


@query("rep_cross_concept", "SELECT symbol, count(DISTINCT plate_id) plate_count FROM v_stocks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30", ("v_stocks",))
def rep_cross_concept(t: Tables):
    return R.nlargest(PL.plates_per_stock(t.stocks), 30, "plate_count", "symbol")


@query("rep_core_matrix", _sql_tops("SELECT symbol, name, count(*) n FROM r WHERE symbol IN (SELECT symbol FROM ts) AND name IN (SELECT name FROM tn) GROUP BY 1,2"), ("v_stocks", "v_derived"))
def rep_core_matrix(t: Tables):
    return PL.core_matrix(t.stocks, t.derived).where("n > 0")


@query("rep_chain_detail", """SELECT c.plate_id, d.name, count(*) chain_count, string_agg(c.name,', ' ORDER BY "order") chain_names FROM v_chains c JOIN v_derived d ON c.plate_id=d.id GROUP BY 1,2 ORDER BY 3 DESC, 1 LIMIT 5""", ("v_chains", "v_derived"))
def rep_chain_detail(t: Tables):
    return PL.chain_detail(t.chains, t.derived)


@query("rep_plate_summary", """SELECT id, name, "desc", avg_pcp_pct, core_avg_pcp_pct, fund_flow_yi, rise_count, fall_count, stay_count, total_stocks, core_stocks_count, rise_ratio, strftime(updated_at,'%Y-%m-%d') updated_on
 FROM v_derived ORDER BY fund_flow_yi DESC NULLS LAST, id""", ("v_derived",))
def rep_plate_summary(t: Tables):
    return PL.plate_summary(t.derived).withColumn("updated_on", F.date_format("updated_at", "yyyy-MM-dd")).drop("updated_at")


@query("build_association_set", ASSOCIATION, PLATE_VIEWS)
def build_association_set(t: Tables):
    return PL.association_set(t.plates, t.stocks, t.chains, t.answers).withColumns(
        {"chains": F.array_join("chains", ","), "gt_stocks": F.array_join("gt_stocks", ",")}
    )


_CONVERTED = """SELECT news_id::VARCHAR sample_id, ticker, sec_short_name, coalesce(exchange_cd,'') exchange_cd, trade_date, coalesce(news_publish_time,'') news_publish_time, coalesce(news_title,'') news_title, news_body, news_summary gt_summary,
 CASE coalesce(sentiment,0) WHEN -1 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END gt_sentiment, coalesce(round(sentiment_score,6),0.0) gt_sentiment_score FROM v_news WHERE news_body<>'' AND news_summary<>''"""


@query("build_news_set", _CONVERTED, ("v_news",))
def build_news_set(t: Tables):
    return PL.news_set(t.news)
