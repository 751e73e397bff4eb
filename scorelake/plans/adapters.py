"""Driver tables as engine inputs: each view as a DataFrame and as the same view in SQL for the checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.grid import literal_models
from scorelake.schemas import PLATE_PAYLOAD
from scorelake.session import stored_once

ERRORS = (
    ("build_prompt_error: missing variable", "prompt_build_failure", "build_prompt", "build_prompt_error"),
    ("gateway_error: Timeout after 60s", "timeout", "gateway", "gateway_timeout"),
    ("gateway_error: HTTP 429", "rate_limit", "gateway", "gateway_rate_limit"),
    ("gateway_error: content Refusal", "refusal", "gateway", "gateway_refusal"),
    ("gateway_error: connection reset", "gateway_failure", "gateway", "gateway_error"),
    ("parse_error: bad literal", "parse_failure", "parse", "parse_error"),
    ("metrics_error: unhashable item", "metrics_failure", "metrics", "metrics_error"),
    ("upstream_s1_missing", "upstream_missing", "upstream", "upstream_missing"),
    ("upstream_s1_parse_failed", "upstream_parse_failed", "upstream", "upstream_parse_failed"),
    ("disk on fire", "unknown_error", "unknown", "unknown_error"),
)
MODEL_IDS = ["m0", "m1", "m2", "m3"]
_PRICES = {"m0": (0.00015, 0.0006), "m1": (0.00027, 0.0011), "m2": (0.00055, 0.00219), "m3": None}


def nth(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


class Tables:
    """The driver's tables at one scale, and the engine views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def models(self) -> DataFrame:
        rows = [(m, "openai_compatible", {"temperature": "0", "api_key": f"sk-{m}", "seed": "42"}, _PRICES[m]) for m in MODEL_IDS]
        return literal_models(self.spark, rows)

    @cached_property
    def results(self) -> DataFrame:
        return results_from_events(self.table("events"))

    @cached_property
    def costed(self) -> DataFrame:
        from scorelake.functions.keys import call_cost
        from scorelake.operators.grid import with_price

        priced = with_price(self.results, self.models)
        cost = call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price"), F.col("from_cache"))
        return priced.withColumn("cost_estimate", cost).drop("price")

    @cached_property
    def samples(self) -> DataFrame:
        docs, labels = self.table("documents"), self.table("labels")
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id"), F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("body"), "lang",
            F.col("quality").alias("gt_quality"), F.col("toxic").alias("gt_toxic"),
        )

    @cached_property
    def news(self) -> DataFrame:
        d = self.table("documents")
        i = F.col("doc_id")
        null_at = lambda n, c: F.when(i % n != 0, c)
        return d.select(
            i.alias("news_id"),
            F.concat(F.lit("2026-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("trade_date"),
            F.col("lang").alias("ticker"), F.col("source").alias("sec_short_name"),
            null_at(4, F.concat(F.lit("X"), (i % 3).cast("string"))).alias("exchange_cd"),
            null_at(5, F.lit("2026-01-01 09:30:00")).alias("news_publish_time"),
            null_at(7, F.concat("source", F.lit(" "), "lang")).alias("news_title"),
            null_at(11, F.when(i % 13 == 0, "").otherwise(F.col("text"))).alias("news_body"),
            null_at(17, F.concat(F.lit("about "), "source")).alias("news_summary"),
            null_at(6, (i % 4 - 1).cast("int")).alias("sentiment"),
            null_at(9, F.col("n_chars") / F.lit(1000.0)).alias("sentiment_score"),
        )

    @cached_property
    def outputs(self) -> DataFrame:
        """Raw output text of every document in seven shapes; the class follows from the id."""
        d = self.table("documents")
        plain = F.to_json(F.struct(
            F.col("lang").alias("label"), F.col("n_chars").alias("score"), (F.col("n_chars") / F.lit(8.0)).alias("ratio"),
            F.col("text").alias("summary"), F.array("source", "lang").alias("tags"),
        ))
        body = F.regexp_replace(plain, r"\}$", "")
        quoted = F.concat(
            F.lit("{'label': '"), "lang", F.lit("', 'score': "), F.col("n_chars").cast("string"),
            F.lit(", 'flag': True, 'summary': '"), F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")),
            F.lit("', 'tags': ['"), "source", F.lit("', '"), "lang", F.lit("']}"),
        )
        kind = F.col("doc_id") % 7
        text = (
            F.when(kind == 0, plain)
            .when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(kind == 2, F.concat(body, F.lit(",}")))
            .when(kind == 3, quoted)
            .when(kind == 4, F.concat(F.lit("Answer: "), plain, F.lit(" Done.")))
            .when(kind == 5, body)
            .otherwise(F.lit(" \n "))
        )
        return d.select("doc_id", "lang", "source", "n_chars", "text", text.alias("output_text"))

    @cached_property
    def requests(self) -> DataFrame:
        """One request per conversation turn, with its cache key."""
        from scorelake.functions.keys import cache_id, cache_key

        c = self.table("conversations")
        empty = F.create_map(F.lit("seed"), F.lit("42"), F.lit("model"), F.lit("x"))
        key = cache_key(
            F.concat(F.lit("m"), (F.col("turn") % 4).cast("string")), empty, F.create_map(F.lit("temperature"), F.lit("0")),
            F.array(F.struct("role", F.col("text").alias("content"))),
            cache_id(F.col("conv_id").cast("string"), F.col("turn"), F.lit("chat")),
        )
        return c.select("conv_id", "turn", "role", "text", key.alias("cache_key"))

    @cached_property
    def cache(self) -> DataFrame:
        """Entries for all user turns; some are bad (no content)."""
        r = self.requests.where(F.col("role") == "user")
        return r.select("cache_key", F.when(F.col("turn") % 4 != 3, F.upper("role")).alias("content"), F.lit(True).alias("success"))

    @cached_property
    def steps(self) -> DataFrame:
        n, t = F.length("text"), F.col("turn")
        ok, needs = n % 5 != 0, t % 3 != 2
        parsed = ok & needs & (n % 7 != 0)
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("sample_id"),
            F.concat(F.lit("wf"), (F.col("conv_id") % 3).cast("string")).alias("workflow_name"),
            t.alias("ord"),
            F.concat(F.lit("s"), t.cast("string")).alias("step_id"),
            F.when(t == 0, "sample").when(t % 5 == 4, "s9").otherwise(F.concat(F.lit("s"), (t - 1).cast("string"))).alias("input_from"),
            F.concat(F.lit("m"), (t % 4).cast("string")).alias("model_id"),
            ok.alias("success"), needs.alias("parse_applicable"), parsed.alias("parse_success"),
            F.when(parsed, F.col("text")).alias("parsed"), F.col("text").alias("raw"),
            (t % 4 != 3).alias("executed"),
            (n * F.lit(1.5)).alias("latency_ms"), (n % 100).cast("int").alias("total_tokens"),
            (t % 2).cast("int").alias("retry_count"), (n / F.lit(1000000.0)).alias("cost_estimate"),
        )

    @cached_property
    def plates(self) -> DataFrame:
        i = F.col("s_suppkey")
        null_at = lambda n, c: F.when(i % n != 0, c)
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            i.alias("id"),
            F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name"),
            F.when(i % 9 == 0, " short ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" of "), "n_name", F.lit(" "))).alias("desc"),
            null_at(17, (i % 21 - 10) / F.lit(1000.0)).alias("avg_pcp"),
            null_at(19, (i % 13 - 6) / F.lit(1000.0)).alias("core_avg_pcp"),
            (i % 7).alias("rise_count"), (i % 5).alias("fall_count"), (i % 3).alias("stay_count"),
            null_at(29, F.col("s_acctbal") * F.lit(1e6)).alias("fund_flow"),
            (i % 40).alias("core_stocks_count"),
            F.when(i % 23 == 0, "not a time").otherwise(
                F.concat(F.lit("2026-02-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))).alias("updated_at"),
        )

    @cached_property
    def derived(self) -> DataFrame:
        from scorelake.operators.projections import derive_plates

        return derive_plates(self.plates)

    @cached_property
    def stocks(self) -> DataFrame:
        from scorelake.functions.text import zero_fill

        grouped = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("r")
        )
        p = F.col("l_partkey")
        core = (F.col("r") == 1) & (p % (F.lit(2) + F.col("l_suppkey") % 40) == 0)
        return grouped.select(
            F.col("l_suppkey").alias("plate_id"), zero_fill(p.cast("string")).alias("symbol"),
            F.when(core, F.lit(100)).when(p % 31 != 0, (p % 7).cast("int")).alias("core_flag"),
        )

    @cached_property
    def chains(self) -> DataFrame:
        n = F.col("l_linenumber")
        return self.table("lineitem").select("l_suppkey", "l_linenumber").distinct().select(
            F.col("l_suppkey").alias("plate_id"), n.alias("chain_id"),
            F.concat(F.lit("step "), (n % 5).cast("string")).alias("name"), (F.lit(8) - n).alias("order"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        return self.table("pages").select(
            F.col("page_id").alias("plate_id"),
            F.when(F.col("page_id") % 4 == 3, "其他").otherwise("板块介绍").alias("question"),
            F.col("html").alias("html_answer"),
        )

    @cached_property
    def payloads(self) -> DataFrame:
        """Landed payloads, one per part; the child lists come from the row itself.

        The lines are landed as files before they are parsed. A line is many times as long as its row, so rows are dealt out first: a few row groups of parts
        would be a few tasks of parsing.
        """
        i = F.col("p_partkey")
        child = lambda n, f: F.transform(F.sequence(F.lit(1), n), f)
        stock = lambda k: F.struct(
            F.concat((i * 10 + k).cast("string"), F.lit(".SZ")).alias("symbol"), F.col("p_type").alias("desc"),
            F.when(k % 2 == 0, F.lit("u")).alias("desc_url"), k.cast("bigint").alias("industrial_chain_id"),
            F.when(k % 3 != 0, k % 3 == 1).alias("is_new"), (k % 2 == 0).alias("need_pay"),
            F.when(k == 1, F.lit(100)).otherwise(F.lit(0)).cast("bigint").alias("core_flag"),
        )
        data = F.struct(
            i.alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("desc"),
            (F.col("p_retailprice") / F.lit(10.0)).alias("avg_pcp"), (i % 3 == 0).alias("has_north"),
            child(F.col("p_size") % 5 + 1, stock).alias("stocks"),
            F.when(i % 2 == 0, child(F.lit(2), lambda k: F.struct(
                k.cast("bigint").alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("name"), (F.lit(9) - k).cast("bigint").alias("order")
            ))).alias("industrial_chains"),
            F.array(F.struct(F.lit("q").alias("question"), F.col("p_brand").alias("html_answer"))).alias("question_answers"),
        )
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        landed = self.table("part").repartition(tasks).select(F.to_json(F.struct(
            F.when(i % 10 == 0, 50000).otherwise(20000).alias("code"), F.when(i % 10 == 0, "busy").otherwise("OK").alias("message"),
            F.when(i % 10 != 0, data).alias("data"),
        )).alias("line"))
        return stored_once(landed, "landed").select(F.from_json("line", PLATE_PAYLOAD).alias("r")).select("r.*")

    # --- scored pairs: parsed and sample as structs -------------------------------------------------------

    @cached_property
    def pair_choice(self) -> DataFrame:
        i, lang = F.col("doc_id"), F.col("lang")
        pred = F.when(i % 3 == 0, F.upper(lang)).when(i % 3 == 1, F.concat(F.lit("  "), lang, F.lit(" "))).otherwise(F.lit("en"))
        pred = F.when(i % 20 != 0, pred)
        label = F.when(i % 10 != 0, lang)
        return self.table("documents").select(
            "doc_id", F.when(i % 50 != 1, F.struct(pred.alias("value"))).alias("parsed"), F.struct(label.alias("value")).alias("sample")
        )

    @cached_property
    def pair_num(self) -> DataFrame:
        sums = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum(F.col("l_extendedprice").cast("decimal(38,2)")).cast("double").alias("label")
        )
        return self.table("orders").join(sums, "o_orderkey", "left").select(
            "o_orderkey", "o_custkey", F.struct(F.col("o_totalprice").alias("value")).alias("parsed"), F.struct(F.col("label").alias("value")).alias("sample")
        )

    @cached_property
    def pair_list(self) -> DataFrame:
        """Item sets per order; an item is one of ten digits, so a set stays tiny however many lines an order has."""
        li = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        item = F.concat(F.lit("Item "), (F.col("p_size") % 10).cast("string"))
        flag = F.col("l_returnflag")
        return li.groupBy("l_orderkey").agg(
            F.collect_set(F.when(flag.isin("R", "N"), F.upper(item))).alias("p"),
            F.collect_set(F.when(flag.isin("A", "N"), item)).alias("t"),
        ).select("l_orderkey", F.struct(F.col("p").alias("items")).alias("parsed"), F.struct(F.col("t").alias("items")).alias("sample"))

    @cached_property
    def pair_text(self) -> DataFrame:
        """Each document's whole text against the next document's."""
        d = self.table("documents").select("doc_id", "text")
        nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ref"))
        return d.join(nxt, "doc_id", "left").select(
            "doc_id", F.struct(F.col("text").alias("value")).alias("parsed"), F.struct(F.col("ref").alias("gt_value")).alias("sample")
        )

    @cached_property
    def pair_reason(self) -> DataFrame:
        """Answer is the second word; the lines of the whole text are the steps, the source is a claim."""
        words = F.split(F.regexp_replace("text", r"\n", " "), " ")
        return self.table("documents").select(
            "doc_id",
            F.struct(
                F.get(words, F.lit(1)).alias("final_answer"), F.split("text", "\n").alias("steps"),
                F.array(F.struct(F.col("source").alias("text"), F.array(F.col("source"), F.upper("lang")).alias("evidence")),
                        F.struct(F.col("lang").alias("text"), F.array(F.col("lang"), (F.col("doc_id") % 5).cast("string")).alias("evidence"))).alias("claims"),
            ).alias("parsed"),
            F.struct(F.when(F.col("doc_id") % 9 != 0, F.array(F.col("lang"), (F.col("doc_id") % 4).cast("string"), F.lit("x"))).alias("gt_evidence_ids"),
                     F.lit("the").alias("gt_final_answer")).alias("sample"),
        )


def results_from_events(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    ok = i % 7 != 0
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    ts = F.col("ts").cast("timestamp")
    metrics = F.array(
        F.struct(F.lit("acc").alias("name"), F.when(i % 3 == 0, 1.0).otherwise(0.0).alias("value")),
        F.struct(F.lit("gap").alias("name"), F.when(i % 4 != 0, F.round(F.col("value") / F.lit(10.0), 3)).alias("value")),
    )
    return e.select(
        i.alias("event_id"), F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("task_name"),
        F.lit("v1").alias("task_version"), F.lit("__task__").alias("step_id"), F.concat("event_type", F.lit(".v1")).alias("prompt_version"),
        F.concat(F.lit("m"), (i % 4).cast("string")).alias("model_id"), i.cast("int").alias("repeat_idx"),
        nth(["task", "workflow_step", "workflow_e2e"], i % 3).alias("mode"),
        F.concat(F.lit("wf"), (i % 2).cast("string")).alias("workflow_name"), F.lit("v1").alias("workflow_version"),
        ok.alias("success"), (i % 5 != 0).alias("parse_applicable"), (ok & (i % 11 != 0)).alias("parse_success"),
        F.col("value").alias("latency_ms"), k.alias("prompt_tokens"), (i % 50).cast("int").alias("completion_tokens"),
        (k + (i % 50).cast("int")).alias("total_tokens"), (i % 3).cast("int").alias("retry_count"), (i % 6 == 0).alias("from_cache"),
        F.when(ok, "").otherwise(nth([x[0] for x in ERRORS], i % 10)).alias("error"),
        F.when(ok | (i % 3 == 0), "").otherwise(nth([x[1] for x in ERRORS], i % 10)).alias("error_type"),
        F.when(ok, "").otherwise(nth([x[2] for x in ERRORS], i % 10)).alias("error_stage"),
        F.repeat(F.concat("props", F.lit(" ")), 20).alias("output_text"), metrics.alias("task_metrics"),
        ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


# --- the same views in SQL -------------------------------------------------------------------------------

_E = [sql_list([x[c] for x in ERRORS]) for c in range(4)]
_PRED_SQL = "CASE WHEN doc_id%20=0 THEN NULL WHEN doc_id%3=0 THEN upper(lang) WHEN doc_id%3=1 THEN '  '||lang||' ' ELSE 'en' END"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_models": ("""SELECT * FROM (VALUES ('m0',0.00015::DOUBLE,0.0006::DOUBLE),('m1',0.00027,0.0011),('m2',0.00055,0.00219),('m3',NULL,NULL)) x(model_id,p_in,p_out)""", ()),
    "v_results": (f"""SELECT event_id, CAST(user_id AS VARCHAR) sample_id, event_type task_name, 'v1' task_version, '__task__' step_id,
  event_type||'.v1' prompt_version, 'm'||(event_id%4) model_id, CAST(event_id AS INTEGER) repeat_idx,
  {sql_list(["task", "workflow_step", "workflow_e2e"])}[(event_id%3)::INT+1] AS mode, 'wf'||(event_id%2) workflow_name, 'v1' workflow_version,
  event_id%7<>0 success, event_id%5<>0 parse_applicable, (event_id%7<>0 AND event_id%11<>0) parse_success, value latency_ms,
  CAST(regexp_extract(props,'(\\d+)',1) AS INTEGER) prompt_tokens, CAST(event_id%50 AS INTEGER) completion_tokens,
  CAST(CAST(regexp_extract(props,'(\\d+)',1) AS INTEGER)+event_id%50 AS INTEGER) total_tokens, CAST(event_id%3 AS INTEGER) retry_count,
  event_id%6=0 from_cache, CASE WHEN event_id%7<>0 THEN '' ELSE {_E[0]}[(event_id%10)::INT+1] END error,
  CASE WHEN event_id%7<>0 OR event_id%3=0 THEN '' ELSE {_E[1]}[(event_id%10)::INT+1] END error_type,
  CASE WHEN event_id%7<>0 THEN '' ELSE {_E[2]}[(event_id%10)::INT+1] END error_stage,
  repeat(props||' ',20) output_text, CASE WHEN event_id%3=0 THEN 1.0::DOUBLE ELSE 0.0 END m_acc,
  CASE WHEN event_id%4<>0 THEN round(value/10.0::DOUBLE,3) END m_gap, ts, strftime(ts,'%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events""", ()),
    "v_costed": ("""SELECT r.*, CASE WHEN from_cache THEN 0.0::DOUBLE ELSE round(prompt_tokens/1000.0::DOUBLE*coalesce(p_in,0)+completion_tokens/1000.0::DOUBLE*coalesce(p_out,0),8) END cost_estimate
  FROM v_results r JOIN v_models USING (model_id)""", ("v_results", "v_models")),
    "v_samples": ("""SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) sample_id, text body, lang, quality gt_quality, toxic gt_toxic FROM documents d LEFT JOIN labels USING (doc_id)""", ()),
    "v_news": ("""SELECT doc_id news_id, '2026-01-'||lpad((doc_id%28+1)::VARCHAR,2,'0') trade_date, lang ticker, source sec_short_name,
  CASE WHEN doc_id%4<>0 THEN 'X'||(doc_id%3) END exchange_cd, CASE WHEN doc_id%5<>0 THEN '2026-01-01 09:30:00' END news_publish_time,
  CASE WHEN doc_id%7<>0 THEN source||' '||lang END news_title,
  CASE WHEN doc_id%11=0 THEN NULL WHEN doc_id%13=0 THEN '' ELSE text END news_body, CASE WHEN doc_id%17<>0 THEN 'about '||source END news_summary,
  CASE WHEN doc_id%6<>0 THEN (doc_id%4-1)::INTEGER END sentiment, CASE WHEN doc_id%9<>0 THEN n_chars/1000.0::DOUBLE END sentiment_score FROM documents""", ()),
    "v_steps": ("""SELECT CAST(conv_id AS VARCHAR) sample_id, 'wf'||(conv_id%3) workflow_name, turn AS ord, 's'||turn step_id,
  CASE WHEN turn=0 THEN 'sample' WHEN turn%5=4 THEN 's9' ELSE 's'||(turn-1) END input_from, 'm'||(turn%4) model_id,
  length(text)%5<>0 success, turn%3<>2 parse_applicable, (length(text)%5<>0 AND turn%3<>2 AND length(text)%7<>0) parse_success,
  CASE WHEN length(text)%5<>0 AND turn%3<>2 AND length(text)%7<>0 THEN text END parsed, text raw, turn%4<>3 executed,
  length(text)*1.5::DOUBLE latency_ms, (length(text)%100)::INTEGER total_tokens, (turn%2)::INTEGER retry_count, length(text)/1000000.0::DOUBLE cost_estimate FROM conversations""", ()),
    "v_plates": ("""SELECT s_suppkey id, '  '||s_name||' ' AS name, CASE WHEN s_suppkey%9=0 THEN ' short ' ELSE ' '||s_name||' of '||n_name||' ' END AS "desc",
  CASE WHEN s_suppkey%17<>0 THEN (s_suppkey%21-10)/1000.0::DOUBLE END avg_pcp, CASE WHEN s_suppkey%19<>0 THEN (s_suppkey%13-6)/1000.0::DOUBLE END core_avg_pcp,
  s_suppkey%7 rise_count, s_suppkey%5 fall_count, s_suppkey%3 stay_count, CASE WHEN s_suppkey%29<>0 THEN s_acctbal*1e6 END fund_flow, s_suppkey%40 core_stocks_count,
  CASE WHEN s_suppkey%23=0 THEN 'not a time' ELSE '2026-02-'||lpad((s_suppkey%28+1)::VARCHAR,2,'0')||' 10:00:00' END updated_at
  FROM supplier JOIN nation ON s_nationkey=n_nationkey""", ()),
    "v_derived": ("""SELECT id, trim(name) AS name, trim("desc") AS "desc", avg_pcp, core_avg_pcp, rise_count, fall_count, stay_count, fund_flow, core_stocks_count,
  try_cast(updated_at AS TIMESTAMP) updated_at, avg_pcp*100 avg_pcp_pct, core_avg_pcp*100 core_avg_pcp_pct, fund_flow/1e8 fund_flow_yi,
  rise_count+fall_count+stay_count total_stocks, rise_count::DOUBLE/nullif(rise_count+fall_count+stay_count,0) rise_ratio,
  core_stocks_count::DOUBLE/nullif(rise_count+fall_count+stay_count,0) core_ratio FROM v_plates""", ("v_plates",)),
    "v_stocks": ("""SELECT l_suppkey plate_id, lpad(l_partkey::VARCHAR, greatest(6,length(l_partkey::VARCHAR))::INT, '0') symbol,
  (CASE WHEN max((l_returnflag='R')::INT)=1 AND l_partkey%(2+l_suppkey%40)=0 THEN 100 WHEN l_partkey%31<>0 THEN l_partkey%7 END)::INTEGER core_flag
  FROM lineitem GROUP BY l_suppkey,l_partkey""", ()),
    "v_chains": ("""SELECT plate_id, chain_id, 'step '||(chain_id%5) AS name, 8-chain_id AS "order" FROM (SELECT DISTINCT l_suppkey plate_id, l_linenumber chain_id FROM lineitem)""", ()),
    "v_qa": ("""SELECT page_id plate_id, CASE WHEN page_id%4=3 THEN '其他' ELSE '板块介绍' END question, html html_answer FROM pages""", ()),
    "v_choice": (f"""SELECT doc_id, doc_id%50<>1 AS has_parsed, CASE WHEN doc_id%50<>1 THEN {_PRED_SQL} END pred, CASE WHEN doc_id%10<>0 THEN lang END label FROM documents""", ()),
    "v_num": ("""SELECT o_orderkey, o_custkey, o_totalprice pred, label FROM orders LEFT JOIN (SELECT l_orderkey o_orderkey, sum(l_extendedprice::DECIMAL(38,2))::DOUBLE label FROM lineitem GROUP BY 1) USING (o_orderkey)""", ()),
    "v_list": ("""SELECT l_orderkey, list(DISTINCT 'item '||(p_size%10)) FILTER (l_returnflag IN ('R','N')) p, list(DISTINCT 'item '||(p_size%10)) FILTER (l_returnflag IN ('A','N')) t
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1""", ()),
    "v_list_counts": ("""SELECT l_orderkey, coalesce(len(p),0) np, coalesce(len(t),0) nt, coalesce(len(list_intersect(p,t)),0) ni FROM v_list""", ("v_list",)),
    "v_list_scores": ("""SELECT *, CASE WHEN np>0 THEN ni::DOUBLE/np ELSE 0.0 END pr, CASE WHEN nt>0 THEN ni::DOUBLE/nt ELSE 0.0 END rc FROM v_list_counts""", ("v_list_counts",)),
}


def with_views(body: str, *names: str) -> str:
    """A query preceded by the views it needs, each once and after those it builds on."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][1]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        need(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in ordered) + "\n" + body
