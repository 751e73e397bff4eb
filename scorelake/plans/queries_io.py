"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import aggregates as A
from scorelake.operators import checks as K
from scorelake.operators import projections as P
from scorelake.plans import plates as PL
from scorelake.plans import reports as R
from scorelake.plans.adapters import Tables
from scorelake.plans.registry import query
from scorelake.plans.runs import run_registry_row, snapshot_rows
from scorelake.schemas import MODEL_FILE
from scorelake.session import shared_dir, stored_once
from scorelake.sources import readers as S
from scorelake.sources import writers as W
from scorelake.sources.fingerprints import tree_fingerprints
from scorelake.sources.versions import TableGroup


@query("src_samples", "SELECT sample_id, body, lang, gt_quality FROM v_samples", ("v_samples",))
def src_samples(t: Tables):
    path = shared_dir(t.spark, "samples")
    t.samples.write.json(path)
    return S.read_samples(t.spark, path, "sample_id string, body string, lang string, gt_quality int")


@query("src_results", "SELECT sample_id, task_name, repeat_idx, success, latency_ms FROM v_results WHERE event_id%13<>0", ("v_results",))
def src_results(t: Tables):
    path = shared_dir(t.spark, "lines")
    line = F.to_json(F.struct("sample_id", "task_name", "repeat_idx", "success", "latency_ms"))
    t.results.select(F.when(F.col("event_id") % 13 == 0, F.left(line, F.length(line) - 4)).otherwise(line)).write.text(path)
    return S.read_results(t.spark, path).select("sample_id", "task_name", "repeat_idx", "success", "latency_ms")


@query("src_results_odd", """SELECT sample_id, CASE event_id%5 WHEN 0 THEN 0 ELSE repeat_idx END AS repeat_idx, latency_ms, CASE WHEN event_id%5<>4 THEN m_acc END acc, success FROM v_results""", ("v_results",))
def src_results_odd(t: Tables):
    """Lines with text or fractional repeats, text latencies, and metrics as an object, a list, or of an unknown kind: none is lost."""
    path = shared_dir(t.spark, "lines")
    i, text = F.col("event_id") % 5, lambda c: F.col(c).cast("string")
    quoted = lambda c: F.concat(F.lit('"'), text(c), F.lit('"'))
    acc = F.coalesce(F.col("task_metrics")[0]["value"].cast("string"), F.lit("null"))
    repeat = F.when(i == 0, '"bad"').when(i == 1, F.concat(text("repeat_idx"), F.lit(".0"))).when(i == 2, quoted("repeat_idx")).otherwise(text("repeat_idx"))
    latency = F.when(i == 3, quoted("latency_ms")).otherwise(text("latency_ms"))
    metrics = F.when(i == 4, '"none"').when(i % 2 == 0, F.concat(F.lit('{"acc":'), acc, F.lit("}"))).otherwise(F.concat(F.lit('[{"name":"acc","value":'), acc, F.lit("}]")))
    line = F.concat(F.lit('{"sample_id":'), quoted("sample_id"), F.lit(',"repeat_idx":'), repeat, F.lit(',"latency_ms":'), latency, F.lit(',"success":'), text("success"),
                    F.lit(',"task_metrics":'), metrics, F.lit("}"))
    t.results.select(line).write.text(path)
    return S.read_results(t.spark, path).select("sample_id", "repeat_idx", "latency_ms", F.get("task_metrics", F.lit(0))["value"].alias("acc"), "success")


@query("src_results_bad_lines", "SELECT count(*) bad_lines FROM events WHERE event_id%13=0")
def src_results_bad_lines(t: Tables):
    path = shared_dir(t.spark, "lines")
    line = F.to_json(F.struct("sample_id", "repeat_idx"))
    t.results.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(line)).write.text(path)
    return S.bad_line_count(t.spark, path)


_SUMMARY_TEXT = """SELECT task_name, model_id, count(*)::VARCHAR request_count, sum(retry_count)::VARCHAR retry_count,
 round(count(*) FILTER (success)/count(*)::DOUBLE,4)::VARCHAR success_rate FROM v_costed GROUP BY 1,2"""


@query("src_summary_csv", _SUMMARY_TEXT, ("v_costed",))
def src_summary_csv(t: Tables):
    path = shared_dir(t.spark, "csv")
    W.write_summary([A.summarize(t.costed)], path)
    return S.read_summary_csv(t.spark, path).select("task_name", "model_id", "request_count", "retry_count", "success_rate")


@query("src_news_parquet", """SELECT * FROM v_news WHERE news_body IS NOT NULL AND news_body<>'' AND news_summary IS NOT NULL AND news_summary<>''""", ("v_news",))
def src_news_parquet(t: Tables):
    path = shared_dir(t.spark, "news")
    t.news.withColumn("unused", F.col("news_id")).write.parquet(path)
    return S.read_news(t.spark, path)


@query("src_plate_tables", """SELECT p.id, p.name, count(symbol) n FROM v_plates p LEFT JOIN v_stocks s ON p.id=s.plate_id GROUP BY ALL""", ("v_plates", "v_stocks"))
def src_plate_tables(t: Tables):
    folder = shared_dir(t.spark, "plates")
    for name, df in {"plates": t.plates, "stocks": t.stocks, "industrial_chains": t.chains, "question_answers": t.answers}.items():
        df.write.parquet(f"{folder}/{name}")
    tables = S.read_plate_tables(t.spark, folder)
    return PL.core_counts(tables["plates"], tables["stocks"], None, None).select("id", "name", F.col("total_count").alias("n"))


_PAY = "part, LATERAL (SELECT unnest(range(1, p_size%5+2)) k) WHERE p_partkey%10<>0"


@query("src_plate_payload", f"""SELECT p_partkey plate_id, (p_partkey*10+k)::VARCHAR symbol, CASE WHEN k%2=0 THEN 'u' ELSE '' END desc_url,
 (k%3=1)::INTEGER is_new, (k%2=0)::INTEGER need_pay, CASE WHEN k=1 THEN 100 ELSE 0 END::BIGINT core_flag FROM {_PAY}""")
def src_plate_payload(t: Tables):
    path = shared_dir(t.spark, "payloads")
    t.payloads.write.json(path)
    tables = S.split_payloads(S.read_plate_payloads(t.spark, path), F.lit("2026-01-01 00:00:00"))
    return tables["stocks"].select("plate_id", "symbol", "desc_url", "is_new", "need_pay", "core_flag")


@query("src_plate_payload_tables", """SELECT p_partkey id, p_name AS name, '' AS "desc", p_retailprice/10.0::DOUBLE avg_pcp, (p_partkey%3=0)::INTEGER has_north,
 CASE WHEN p_partkey%2=0 THEN 2 ELSE 0 END::BIGINT chains, 1::BIGINT answers FROM part WHERE p_partkey%10<>0""")
def src_plate_payload_tables(t: Tables):
    tables = S.split_payloads(t.payloads, F.lit("2026-01-01 00:00:00"))
    chains = A.group_sizes(tables["industrial_chains"], ["plate_id"], "chains")
    answers = A.group_sizes(tables["question_answers"], ["plate_id"], "answers")
    return (
        tables["plates"].select("id", "name", "desc", "avg_pcp", "has_north")
        .join(chains.withColumnRenamed("plate_id", "id"), "id", "left").join(answers.withColumnRenamed("plate_id", "id"), "id", "left")
        .na.fill(0, ["chains", "answers"])
    )


@query("src_plate_payload_rejects", "SELECT 50000::INTEGER code, 'busy' message, count(*) n FROM part WHERE p_partkey%10=0")
def src_plate_payload_rejects(t: Tables):
    return S.rejected_payloads(t.payloads).groupBy("code", "message").agg(F.count("*").alias("n"))


_MODEL_SQL = """SELECT s_name model_id, CASE WHEN s_suppkey%3=0 THEN 'unknown' ELSE 'openai_compatible' END provider, (s_suppkey%8)::VARCHAR concurrency,
 CASE WHEN s_suppkey%2=0 THEN s_suppkey/1000000.0::DOUBLE END input_per_1k, s_suppkey%5=0 AS is_active FROM supplier"""


def _registry(t: Tables):
    i = F.col("s_suppkey")
    entry = F.struct(
        F.when(i % 3 != 0, "openai_compatible").alias("provider"), (i % 8).cast("int").alias("concurrency"),
        F.when(i % 4 == 0, "${API_KEY}").otherwise("sk-1").alias("api_key"),
        F.when(i % 2 == 0, F.struct((i / F.lit(1000000.0)).alias("input_per_1k"))).alias("price_config"),
    )
    doc = F.to_json(F.struct(F.when(i % 5 == 0, F.col("s_name")).otherwise("other").alias("active"), F.create_map("s_name", entry).alias("models")))
    return t.table("supplier").select(F.from_json(doc, MODEL_FILE).alias("r")).select("r.*")


@query("src_models", _MODEL_SQL)
def src_models(t: Tables):
    return S.models_from_file(_registry(t)).select(
        "model_id", "provider", F.col("default_params")["concurrency"].alias("concurrency"), "price_config.input_per_1k", "is_active"
    )


@query("src_fingerprint", """SELECT n dataset_rows, sha256(n::VARCHAR||':'||a::VARCHAR||':'||b::VARCHAR) dataset_sha256 FROM (
 SELECT count(*) n, sum(('0x'||substr(h,1,15))::BIGINT::HUGEINT) a, sum(('0x'||substr(h,16,15))::BIGINT::HUGEINT) b
 FROM (SELECT sha256(doc_id::VARCHAR||chr(1)||text) h FROM documents))""")
def src_fingerprint(t: Tables):
    return S.content_fingerprint(t.table("documents"), ["doc_id", "text"])


@query("src_file_sha256", """WITH f AS (SELECT doc_id // 200 AS file, string_agg(doc_id||'|'||source||'|'||n_chars||'|'||sha256(text)||chr(10), '' ORDER BY doc_id) c FROM documents GROUP BY 1),
 k AS (SELECT *, list_transform(range(0, (length(c) + 1023) // 1024), lambda i: sha256(substr(c, (i * 1024 + 1)::BIGINT, 1024))) chunks FROM f),
 b AS (SELECT *, list_transform(range(0, (len(chunks) + 3) // 4), lambda i: sha256(array_to_string(chunks[i * 4 + 1:i * 4 + 4], ''))) blocks FROM k)
 SELECT file::VARCHAR AS file, length(c)::BIGINT AS length, sha256(c) sha256, sha256(length(c)||':'||array_to_string(blocks, '')) tree_sha256 FROM b""")
def src_file_sha256(t: Tables):
    """Manifest lines of the documents in a file for every 200 ids; each file's plain digest, and its tree digest from byte ranges."""
    path = shared_dir(t.spark, "files")
    line = F.concat_ws("|", "doc_id", "source", "n_chars", F.sha2("text", 256))
    rows = t.table("documents").select((F.floor(F.col("doc_id") / 200)).alias("file"), "doc_id", line.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    plain = S.file_fingerprints(t.spark, f"{path}/file=*").select("path", "length", "sha256")
    trees = tree_fingerprints(t.spark, path, chunk=1024, fan=4).select("path", "tree_sha256")
    return plain.join(trees, "path").select(F.regexp_extract("path", r"/file=(\d+)/", 1).alias("file"), "length", "sha256", "tree_sha256")


@query("src_calls", """SELECT event_id, coalesce(CASE WHEN event_id%8<>0 THEN task_name END,'') AS content, prompt_tokens, completion_tokens, total_tokens,
 latency_ms, success, CASE WHEN event_id%2=0 THEN error ELSE '' END error, '' error_code FROM v_results""", ("v_results",))
def src_calls(t: Tables):
    raw = t.results.select(
        "event_id", F.when(F.col("event_id") % 8 != 0, F.col("task_name")).alias("content"), "prompt_tokens", "completion_tokens",
        "latency_ms", "success", F.when(F.col("event_id") % 2 == 0, F.col("error")).alias("error"),
    )
    return S.normalize_calls(raw).select(
        "event_id", "content", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "success", "error", "error_code"
    )


@query("src_by_model", """SELECT sample_id, repeat_idx, success FROM v_results WHERE task_name='click' AND model_id='m1'""", ("v_results",))
def src_by_model(t: Tables):
    folder = shared_dir(t.spark, "by-model")
    slim = t.results.withColumn("model_id", F.concat(F.lit("org/x:"), "model_id"))
    W.write_by_model(slim.select("sample_id", "task_name", "model_id", "repeat_idx", "success"), folder)
    return S.read_by_model(t.spark, folder, "click", "org/x:m1").select("sample_id", "repeat_idx", "success")


# --- sinks -----------------------------------------------------------------------------------------------

@query("snk_results_append", "SELECT sample_id, repeat_idx, success, error FROM v_results", ("v_results",))
def snk_results_append(t: Tables):
    path = shared_dir(t.spark, "append")
    slim = t.results.select("sample_id", "repeat_idx", "success", "error")
    W.append_results(slim.where("success"), path)
    W.append_results(slim.where("not success"), path)
    return S.read_results(t.spark, path).select("sample_id", "repeat_idx", "success", "error")


@query("snk_partitioned", "SELECT 'org-'||model_id model_id, task_name, count(*) n, sum(repeat_idx)::BIGINT s FROM v_results GROUP BY 1,2", ("v_results",))
def snk_partitioned(t: Tables):
    folder = shared_dir(t.spark, "by-model")
    slim = t.results.withColumn("model_id", F.concat(F.lit("org:"), "model_id")).select("sample_id", "task_name", "model_id", "repeat_idx")
    W.write_by_model(slim, folder)
    back = t.spark.read.schema("sample_id string, repeat_idx int, task_name string, model_id string").option("basePath", folder).json(folder)
    return back.groupBy("model_id", "task_name").agg(F.count("*").alias("n"), F.sum("repeat_idx").alias("s"))


@query("snk_partitioned_twice", "SELECT 'm'||(event_id%4) model_id, count(*) * CASE WHEN event_id%4=1 THEN 2 ELSE 1 END n FROM events GROUP BY event_id%4")
def snk_partitioned_twice(t: Tables):
    """A second write with one model replaces that model's rows and leaves the others."""
    folder = shared_dir(t.spark, "by-model")
    slim = t.results.select("sample_id", F.lit("t").alias("task_name"), "model_id", "repeat_idx")
    W.write_by_model(slim, folder)
    mine = slim.where("model_id = 'm1'")
    W.write_by_model(mine.union(mine), folder)
    back = t.spark.read.schema("sample_id string, repeat_idx int, task_name string, model_id string").option("basePath", folder).json(folder)
    return back.groupBy("model_id").agg(F.count("*").alias("n"))


@query("snk_summary_csv", """SELECT task_name, model_id, n::VARCHAR request_count, a tm_acc_avg FROM (
 SELECT task_name, model_id, count(*) n, NULL::VARCHAR a FROM v_costed WHERE task_name<>'click' GROUP BY 1,2
 UNION ALL SELECT task_name, model_id, count(*) n, round(sum(m_acc)/count(*),4)::VARCHAR FROM v_costed WHERE task_name='click' GROUP BY 1,2)""", ("v_costed",))
def snk_summary_csv(t: Tables):
    path = shared_dir(t.spark, "csv")
    clicks, rest = t.costed.where("task_name = 'click'"), t.costed.where("task_name <> 'click'")
    wide = A.wide_metrics(A.task_metric_averages(clicks), ["acc"])
    W.write_summary([A.summarize(rest), A.summarize(clicks).join(wide, A.SUMMARY_KEYS)], path)
    back = S.read_summary_csv(t.spark, path)
    return back.select("task_name", "model_id", "request_count", "tm_acc_avg")


@query("snk_artifacts", """SELECT 'run1' run_id, 'task' AS mode, (SELECT count(*) FROM documents) dataset_rows, count(*) masked FROM supplier""")
def snk_artifacts(t: Tables):
    folder = shared_dir(t.spark, "registry")
    models = S.models_from_file(_registry(t))
    run = run_registry_row("run1", {"mode": "task"}, S.content_fingerprint(t.table("documents"), ["doc_id", "text"]))
    W.append_run(run, snapshot_rows("run1", P.model_snapshot(models, {"temperature": "1"})), folder)
    masked = t.spark.read.parquet(f"{folder}/model_snapshots").groupBy("run_id").agg(
        F.count_if(F.col("params")["api_key"] == "***").alias("masked"))
    runs = t.spark.read.parquet(f"{folder}/runs").select("run_id", F.col("config")["mode"].alias("mode"), "dataset_rows")
    return runs.join(masked, "run_id")


@query("snk_dataset_jsonl", """SELECT sample_id, gt_quality IS NOT NULL has_quality, body FROM v_samples""", ("v_samples",))
def snk_dataset_jsonl(t: Tables):
    path = shared_dir(t.spark, "jsonl")
    W.write_samples(t.samples.select("sample_id", "body", "gt_quality"), path)
    line = F.col("value")
    return t.spark.read.text(path).select(
        F.get_json_object(line, "$.sample_id").alias("sample_id"),
        F.array_contains(F.json_object_keys(line), "gt_quality").alias("has_quality"),
        F.get_json_object(line, "$.body").alias("body"),
    )


@query("snk_csv_export", """SELECT id::VARCHAR id, name, total_stocks::VARCHAR total_stocks, "desc" FROM v_derived""", ("v_derived",))
def snk_csv_export(t: Tables):
    path = shared_dir(t.spark, "export")
    W.write_csv(PL.plate_summary(t.derived), path, F.desc_nulls_last("fund_flow_yi"), "id")
    return S.read_summary_csv(t.spark, path).select("id", "name", "total_stocks", "desc")


_MD_SUMMARY = """SELECT task_name, model_id, count(*) n, round(count(*) FILTER (success)/count(*)::DOUBLE,4) sr,
 round(count(*) FILTER (parse_applicable AND parse_success)::DOUBLE/count(*) FILTER (parse_applicable),4) pr,
 round(sum(latency_ms::DECIMAL(38,10))::DOUBLE/count(*),2) lat, round(sum(total_tokens)::DOUBLE/count(*),2) tok, round(sum(cost_estimate::DECIMAL(38,10))::DOUBLE,6) cost
 FROM v_costed GROUP BY 1,2"""


@query("snk_markdown", f"""SELECT '| '||task_name||' | '||model_id||' | '||n||' | '||sr||' | '||pr||' | '||lat||' | '||tok||' | '||cost||' |' AS line FROM ({_MD_SUMMARY})
 UNION ALL SELECT '| '||model_id||' | '||sr||' | '||pr||' | '||lat||' | '||cost||' |' FROM ({_MD_SUMMARY})
 UNION ALL SELECT '| '||coalesce(nullif(error_type,''),'unknown_error')||' | '||count(*)||' |' FROM v_costed WHERE NOT success OR (parse_applicable AND NOT parse_success) GROUP BY coalesce(nullif(error_type,''),'unknown_error')
 UNION ALL SELECT '### '||task_name FROM (SELECT DISTINCT task_name FROM v_costed)
 UNION ALL SELECT '| '||workflow_name||' | '||workflow_version||' | '||mode||' | '||model_id||' | '||n||' | '||sr||' | '||pr||' | '||lat||' | '||cost||' |' FROM (
  SELECT workflow_name, workflow_version, mode, {_MD_SUMMARY[7:].replace("task_name, ", "").replace("GROUP BY 1,2", "WHERE mode LIKE 'workflow~_%' ESCAPE '~' GROUP BY workflow_name, workflow_version, mode, model_id")})
 UNION ALL SELECT '- sample_id: `'||sample_id||'`' FROM (SELECT * FROM v_costed WHERE NOT success OR (parse_applicable AND NOT parse_success) ORDER BY "timestamp", sample_id, step_id, model_id, repeat_idx LIMIT 5)""", ("v_costed",))
def snk_markdown(t: Tables):
    """The written report read back, its fixed heading lines left out."""
    path = shared_dir(t.spark, "report")
    results = stored_once(t.costed, "results")
    W.write_report(R.default_reporter({"results": results, "summary": stored_once(A.summarize(results), "summary")}), path)
    line = F.col("value")
    data = line.rlike(r"^\| .* \|$") & ~line.rlike(r"^\| (---|task_name|model_id|workflow_name|error_type)( |\|)")
    return t.spark.read.text(path).where(data | line.startswith("### ") & ~line.contains("失败") | line.startswith("- sample_id")).select(line.alias("line"))


@query("snk_upsert_plates", """SELECT s.plate_id, s.symbol, s.core_flag FROM v_stocks s JOIN v_plates p ON p.id=s.plate_id WHERE coalesce(p.avg_pcp,1)>=0
 UNION ALL SELECT s.plate_id, s.symbol||'N', 1 FROM v_stocks s JOIN v_plates p ON p.id=s.plate_id WHERE p.avg_pcp<0 AND p.core_avg_pcp<0""", ("v_stocks", "v_plates"))
def snk_upsert_plates(t: Tables):
    """Falling plates get a new payload; where their core stocks did not fall it brings no stocks, so the old ones go."""
    folder = shared_dir(t.spark, "upsert")
    parent = t.plates.select("id", "name", "avg_pcp", "core_avg_pcp")
    W.upsert_plates(t.spark, folder, {"plates": parent, "stocks": t.stocks, "industrial_chains": t.chains, "question_answers": t.answers})
    falling = parent.where("avg_pcp < 0")
    of = lambda df, plates: df.join(plates.select(F.col("id").alias("plate_id")), "plate_id", "left_semi")
    new = of(t.stocks, falling.where("core_avg_pcp < 0")).select("plate_id", F.concat("symbol", F.lit("N")).alias("symbol"), F.lit(1).alias("core_flag"))
    W.upsert_plates(t.spark, folder, {
        "plates": falling, "stocks": new, "industrial_chains": of(t.chains, falling), "question_answers": of(t.answers, falling),
    })
    return W.read_plates(t.spark, folder)["stocks"]


@query("snk_versions", """SELECT 1 AS version, 'stocks' AS "table", count(*) n FROM v_stocks UNION ALL SELECT 1, 'plates', count(*) FROM v_plates
 UNION ALL SELECT 2, 'plates', count(*) FROM v_plates UNION ALL SELECT 2, 'stocks', count(*) FILTER (coalesce(avg_pcp, 1) >= 0) FROM v_stocks JOIN v_plates ON id = plate_id""", ("v_stocks", "v_plates"))
def snk_versions(t: Tables):
    """Falling plates lose their stocks in a second version; both versions are read after it."""
    group = TableGroup(t.spark, shared_dir(t.spark, "versions"))
    falling = t.plates.where("avg_pcp < 0")
    first = group.replace({"plates": (t.plates, "id", None), "stocks": (t.stocks, "plate_id", None)})
    second = group.replace({"plates": (falling, "id", None), "stocks": (t.stocks.limit(0), "plate_id", falling.select("id"))})
    named = [group.read(name, v).select(F.lit(v).alias("version"), F.lit(name).alias("table")) for v in (first, second) for name in ("plates", "stocks")]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]).groupBy("version", "table").agg(F.count("*").alias("n"))


@query("snk_upsert_newest", "SELECT p_partkey plate_id, 'N'||(p_partkey*10+k)::VARCHAR symbol FROM part, LATERAL (SELECT unnest(range(1, p_size%5+2)) k) WHERE p_partkey%10<>0")
def snk_upsert_newest(t: Tables):
    """Two payloads of every plate landed, the newer with other symbols: only the newer is left, once."""
    folder = shared_dir(t.spark, "upsert")
    renamed = F.transform("data.stocks", lambda s: s.withField("symbol", F.concat(F.lit("N"), s["symbol"])))
    both = t.payloads.withColumn("landed", F.lit(1)).unionByName(t.payloads.withColumns({"landed": F.lit(2), "data": F.col("data").withField("stocks", renamed)}))
    newest = stored_once(S.newest_payloads(both, "landed"), "payloads")
    W.upsert_plates(t.spark, folder, S.split_payloads(newest, F.lit("2026-01-01 00:00:00")))
    return W.read_plates(t.spark, folder)["stocks"].select("plate_id", "symbol")


@query("chk_api_key", "SELECT s_name model_id FROM supplier WHERE s_suppkey%4=0")
def chk_api_key(t: Tables):
    return K.unresolved_keys(S.models_from_file(_registry(t))).select("model_id")
