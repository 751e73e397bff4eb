"""Scalar functions and the output parser."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions import keys as N
from scorelake.functions import outputs as O
from scorelake.functions import text as X
from scorelake.functions.errors import classify_error, derive_error
from scorelake.operators.metrics import string_set, text_fragments
from scorelake.plans.adapters import ERRORS, Tables, sql_list
from scorelake.plans.queries_rows import STRIP_SQL
from scorelake.plans.queries_stats import _log_lines
from scorelake.plans.registry import query

_SQL_WS = "'[\\s\\p{Z}\\x{85}]+'"


@query("fn_normalize", f"SELECT doc_id, trim(regexp_replace(lower('　 '||text||' Ünd '),{_SQL_WS},' ','g')) x FROM documents")
def fn_normalize(t: Tables):
    return t.table("documents").select("doc_id", X.normalize_text(F.concat(F.lit("　 "), "text", F.lit(" Ünd "))).alias("x"))


_FLOATS = ["1.5", " -2e3 ", "abc", "1d", "", "+.5", "inf", "0x10"]


@query("fn_safe_float", f"SELECT event_id, [1.5,-2000.0,NULL,NULL,NULL,0.5,'inf'::DOUBLE,NULL][(event_id%8+1)::INT]::DOUBLE x FROM events")
def fn_safe_float(t: Tables):
    from scorelake.plans.adapters import nth

    return t.table("events").select("event_id", X.safe_float(nth(_FLOATS, F.col("event_id") % 8)).alias("x"))


@query("fn_text_fragments_deep", "SELECT doc_id, lang||'|'||source fragments FROM documents")
def fn_text_fragments_deep(t: Tables):
    """Texts under known keys six and seven levels down in a value whose shape is known at run time only."""
    d = t.table("documents").select("doc_id", F.concat(
        F.lit('{"summary":{"text":[{"reason":{"content":{"analysis":"'), "lang", F.lit('"}},"claim":{"rationale":{"reason":{"text":"'), "source",
        F.lit('"}}}}]},"other":"left out"}')).alias("j")).select("doc_id", F.parse_json("j").alias("v"))
    return d.select("doc_id", F.array_join(text_fragments(F.col("v"), d.schema["v"].dataType), "|").alias("fragments"))


@query("fn_trailing_commas_many", "SELECT doc_id, '['||doc_id||'] {\"a\":1 }' AS text FROM documents")
def fn_trailing_commas_many(t: Tables):
    text = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(',, ,\n,,] {"a":1 , ,}'))
    return t.table("documents").select("doc_id", O.drop_trailing_commas(text).alias("text"))


@query("fn_text_fragments", "SELECT doc_id, text||'|'||lang||'|'||source fragments FROM documents")
def fn_text_fragments(t: Tables):
    """Texts are taken in key order, blanks left out; ``other`` is not a text key."""
    d = t.table("documents").withColumn("v", F.array(
        F.struct(F.col("source").alias("other"), F.lit(" ").alias("summary"), F.col("text").alias("text"),
                 F.struct(F.col("lang").alias("claim")).alias("reason")),
        F.struct(F.lit("no").alias("other"), F.col("source").alias("summary"), F.lit(None).cast("string").alias("text"),
                 F.struct(F.lit("").alias("claim")).alias("reason")),
    ))
    return d.select("doc_id", F.array_join(text_fragments(F.col("v"), d.schema["v"].dataType), "|").alias("fragments"))


@query("fn_str_set", "SELECT doc_id, array_to_string(list_sort(list_distinct([lower(lang), lower(source)])),',') ids, 1::INTEGER n_text FROM documents")
def fn_str_set(t: Tables):
    kind = T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))
    obj = F.transform(F.array(F.upper("lang"), "source", F.lit(" "), "lang"), lambda x: F.struct(x.alias("id")))
    return t.table("documents").select(
        "doc_id", F.array_join(F.array_sort(string_set(obj, kind, True)), ",").alias("ids"),
        F.size(string_set(F.col("lang"), T.StringType(), True)).alias("n_text"),
    )


_CLASS = """SELECT doc_id, ['ok','ok','ok','ok','ok','truncated','empty'][(doc_id%7+1)::INT] reason,
 ['full_text','fenced_block','full_text','full_text','balanced_extract','balanced_extract','none'][(doc_id%7+1)::INT] strategy,
 CASE WHEN doc_id%7<5 THEN lang END label, CASE WHEN doc_id%7<5 THEN n_chars END score, CASE WHEN doc_id%7<5 THEN text END summary FROM documents"""


def _parsed(t: Tables, native: bool = True):
    return O.parse_outputs(t.outputs.select("doc_id", "output_text"), native=native).select(
        "doc_id", "parse.reason", "parse.strategy",
        F.try_variant_get("parse.data", "$.label", "string").alias("label"),
        F.try_variant_get("parse.data", "$.score", "bigint").alias("score"),
        F.try_variant_get("parse.data", "$.summary", "string").alias("summary"),
    )


@query("fn_parse_json", _CLASS)
def fn_parse_json(t: Tables):
    return _parsed(t)


@query("fn_parse_json_udf_tier", _CLASS)
def fn_parse_json_udf_tier(t: Tables):
    """The same with every row through the UDF tier: both tiers must agree."""
    return _parsed(t, native=False)


@query("fn_fence", "SELECT doc_id, CASE WHEN doc_id%2=0 THEN text END body FROM (SELECT doc_id, trim(text, ' '||chr(10)) text FROM documents)")
def fn_fence(t: Tables):
    fenced = F.concat(F.lit("see\n```json\n"), "text", F.lit("\n```\n```x```"))
    return t.table("documents").select("doc_id", O.fenced_block(F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))).alias("body"))


@query("fn_json_marks", "SELECT doc_id, '{\"a\":\"'||text||'\",['']}' x FROM documents")
def fn_json_marks(t: Tables):
    wide = F.concat(F.lit("﻿｛“a”：​“"), "text", F.lit("”，［‘］｝"))
    return t.table("documents").select("doc_id", O.plain_marks(wide).alias("x"))


@query("fn_trailing_commas", "SELECT doc_id, '{\"a\":[\"'||source||'\"]}' x FROM documents")
def fn_trailing_commas(t: Tables):
    messy = F.concat(F.lit('{"a":["'), "source", F.lit('", ,\n],}'))
    return t.table("documents").select("doc_id", O.drop_trailing_commas(messy).alias("x"))


@query("fn_json_comments", "SELECT doc_id, 'ok' reason, source||'//' a, n_chars b FROM documents")
def fn_json_comments(t: Tables):
    messy = F.concat(F.lit('{ // first\n"a": "'), "source", F.lit('//", /* two\nlines */ "b": '), F.col("n_chars").cast("string"), F.lit(", }"))
    rows = O.parse_outputs(t.table("documents").select("doc_id", messy.alias("output_text")))
    return rows.select("doc_id", "parse.reason", F.try_variant_get("parse.data", "$.a", "string").alias("a"), F.try_variant_get("parse.data", "$.b", "bigint").alias("b"))


@query("fn_balanced", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'truncated' WHEN doc_id%3=1 THEN 'ok' ELSE 'invalid_json' END reason, CASE WHEN doc_id%3=1 THEN source END a FROM documents")
def fn_balanced(t: Tables):
    k = F.col("doc_id") % 3
    body = F.concat(F.lit('it is ] {"a":{"b":"}"},"a":"'), "source", F.lit('"'))
    messy = F.when(k == 0, body).when(k == 1, F.concat(body, F.lit("} and {more"))).otherwise(F.lit("see [1, 2] only"))
    rows = O.parse_outputs(t.table("documents").select("doc_id", messy.alias("output_text")))
    return rows.select("doc_id", "parse.reason", F.try_variant_get("parse.data", "$.a", "string").alias("a"))


def _fields(t: Tables):
    """Documents as JSON objects whose fields vary in kind."""
    i = F.col("doc_id")
    vary = lambda *texts: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in texts]), (i % len(texts) + 1).cast("int"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(
        F.lit('{"s":'), vary(q(F.col("source")), "0", '""', "null", "12"),
        F.lit(',"l":'), vary(F.concat(F.lit("["), q(F.col("lang")), F.lit(",1,true,null]")), '"x"', "[]"),
        F.lit(',"e":'), vary('"positive"', '"Positive"', "7", "null"),
        F.lit(',"i":'), vary("3", "3.7", '"4"', '"4.5"', "true", "999", "null"),
        F.lit(',"f":'), vary("0.25", '"1e1"', "-5", "null", '"x"'),
        F.lit(',"r":'), vary('[{"k":1},2]', '"x"'), F.lit("}"),
    )
    return t.table("documents").select("doc_id", "source", F.try_parse_json(text).alias("data"))


_FIELD_SQL = {
    "s": "[source,'none','none','none','12'][(doc_id%5+1)::INT]",
    "l": "[lang||',1,true','','' ][(doc_id%3+1)::INT]",
    "e": "CASE WHEN doc_id%4=0 THEN 'positive' ELSE 'neutral' END",
    "i": "[3,3,4,0,1,5,0][(doc_id%7+1)::INT]::INTEGER",
    "f": "[0.25,1.0,0.0,0.5,0.5][(doc_id%5+1)::INT]::DOUBLE",
    "r": "CASE WHEN doc_id%2=0 THEN 2 ELSE 0 END::INTEGER",
}


@query("fn_field_str", f"SELECT doc_id, {_FIELD_SQL['s']} x FROM documents")
def fn_field_str(t: Tables):
    return _fields(t).select("doc_id", O.field_str(F.col("data"), "s", "none").alias("x"))


@query("fn_field_list", f"SELECT doc_id, {_FIELD_SQL['l']} x FROM documents")
def fn_field_list(t: Tables):
    return _fields(t).select("doc_id", F.array_join(O.field_list(F.col("data"), "l", 3), ",").alias("x"))


@query("fn_field_enum", f"SELECT doc_id, {_FIELD_SQL['e']} x FROM documents")
def fn_field_enum(t: Tables):
    return _fields(t).select("doc_id", O.field_enum(F.col("data"), "e", ["positive", "neutral"], "neutral").alias("x"))


@query("fn_field_int", f"SELECT doc_id, {_FIELD_SQL['i']} x FROM documents")
def fn_field_int(t: Tables):
    return _fields(t).select("doc_id", O.field_int(F.col("data"), "i", 0, -5, 5).alias("x"))


@query("fn_field_float", f"SELECT doc_id, {_FIELD_SQL['f']} x FROM documents")
def fn_field_float(t: Tables):
    return _fields(t).select("doc_id", O.field_float(F.col("data"), "f", 0.5, 0, 1).alias("x"))


@query("fn_field_list_raw", f"SELECT doc_id, {_FIELD_SQL['r']} n, CASE WHEN doc_id%2=0 THEN 1::BIGINT END k FROM documents")
def fn_field_list_raw(t: Tables):
    items = O.field_list_raw(F.col("data"), "r")
    return _fields(t).select("doc_id", F.size(items).alias("n"), F.try_variant_get(F.get(items, F.lit(0)), "$.k", "bigint").alias("k"))


@query("fn_field_any", "SELECT doc_id, CASE WHEN doc_id%4=3 THEN NULL ELSE ['positive','Positive','7'][(doc_id%4+1)::INT] END x, 'd' absent FROM documents")
def fn_field_any(t: Tables):
    text = lambda c: F.try_variant_get(c, "$", "string")
    return _fields(t).select("doc_id", text(O.field_any(F.col("data"), "e")).alias("x"), text(O.field_any(F.col("data"), "zz", "d")).alias("absent"))


_RULES = [
    {"field": "s", "type": "str", "default": "none"}, {"field": "l", "type": "list", "max_len": 3},
    {"field": "e", "type": "enum", "values": ["positive", "neutral"], "default": "neutral"},
    {"field": "i", "type": "int", "default": 0, "lo": -5, "hi": 5}, {"field": "f", "type": "float", "default": 0.5, "lo": 0, "hi": 1},
]


@query("fn_apply_schema", f"""SELECT doc_id, CASE WHEN doc_id%6<>0 THEN {_FIELD_SQL['s']} END s, CASE WHEN doc_id%6<>0 THEN {_FIELD_SQL['l']} END l, CASE WHEN doc_id%6<>0 THEN {_FIELD_SQL['e']} END e,
 CASE WHEN doc_id%6<>0 THEN {_FIELD_SQL['i']} END i, CASE WHEN doc_id%6<>0 THEN {_FIELD_SQL['f']} END f FROM documents""")
def fn_apply_schema(t: Tables):
    data = F.when(F.col("doc_id") % 6 != 0, F.col("data"))
    rows = _fields(t).select("doc_id", O.apply_schema(data, _RULES).alias("p"))
    return rows.select("doc_id", "p.s", F.array_join("p.l", ",").alias("l"), "p.e", "p.i", "p.f")


@query("fn_cost", "SELECT event_id, cost_estimate FROM v_costed", ("v_costed",))
def fn_cost(t: Tables):
    return t.costed.select("event_id", "cost_estimate")


_AT = "(event_id%10+1)::INT"


@query("fn_classify_error", f"""SELECT event_id, CASE WHEN error='' THEN '' ELSE {sql_list([e[1] for e in ERRORS])}[{_AT}] END error_type, CASE WHEN error='' THEN '' ELSE {sql_list([e[2] for e in ERRORS])}[{_AT}] END error_stage,
 CASE WHEN error='' THEN '' ELSE {sql_list([e[3] for e in ERRORS])}[{_AT}] END error_code FROM v_results""", ("v_results",))
def fn_classify_error(t: Tables):
    return t.results.select("event_id", classify_error(F.col("error")).alias("e")).select("event_id", "e.*")


@query("fn_derive_error", f"""SELECT event_id, CASE WHEN event_id%4=0 THEN 'given' WHEN NOT success THEN {sql_list([e[1] for e in ERRORS])}[{_AT}] WHEN parse_applicable AND NOT parse_success THEN 'schema_mismatch' ELSE '' END error_type,
 CASE WHEN event_id%4=0 THEN 'g3' WHEN NOT success THEN {sql_list([e[3] for e in ERRORS])}[{_AT}] WHEN parse_applicable AND NOT parse_success THEN 'parse_empty_or_invalid' ELSE '' END error_code, error error_detail FROM v_results""", ("v_results",))
def fn_derive_error(t: Tables):
    given = lambda x: F.when(F.col("event_id") % 4 == 0, x)
    e = derive_error(F.col("success"), F.col("parse_applicable"), F.col("parse_success"), F.col("error"), given("given"), given("g2"), given("g3"))
    return t.results.select("event_id", e.alias("e")).select("event_id", "e.error_type", "e.error_code", "e.error_detail")


@query("fn_cache_key", """SELECT conv_id, turn, sha256('{"messages":[{"role":"'||role||'","content":'||to_json(text)::VARCHAR||'}],"model_id":"m'||(turn%4)||'","model_params":{"model":"x","seed":"42"},"params":{"temperature":"0"},"sample_id":"'||conv_id||':'||turn||':chat"}') cache_key FROM conversations""")
def fn_cache_key(t: Tables):
    return t.requests.select("conv_id", "turn", "cache_key")


@query("fn_cache_id", "SELECT conv_id, turn, conv_id||':'||turn||':chat' task_id, conv_id||':s'||turn||':chat' step_id FROM conversations")
def fn_cache_id(t: Tables):
    c = F.col("conv_id").cast("string")
    return t.table("conversations").select(
        "conv_id", "turn", N.cache_id(c, F.col("turn"), F.lit("chat")).alias("task_id"),
        N.cache_id(c, F.concat(F.lit("s"), F.col("turn").cast("string")), F.lit("chat")).alias("step_id"),
    )


@query("fn_redact", """SELECT doc_id, '***' api_key, lang name, '***' nested_token, source nested_text, '***' map_secret, lang map_lang FROM documents""")
def fn_redact(t: Tables):
    rows = t.table("documents").select("doc_id", F.struct(
        F.col("source").alias("API_Key"), F.col("lang").alias("name"),
        F.array(F.struct(F.col("lang").alias("access_token"), F.col("source").alias("text"))).alias("items"),
        F.create_map(F.lit("client_secret"), F.col("lang"), F.lit("lang"), F.col("lang")).alias("m"),
    ).alias("p"))
    out = rows.select("doc_id", N.redact(F.col("p"), rows.schema["p"].dataType).alias("p"))
    return out.select(
        "doc_id", F.col("p.API_Key").alias("api_key"), "p.name", F.col("p.items")[0]["access_token"].alias("nested_token"),
        F.col("p.items")[0]["text"].alias("nested_text"), F.col("p.m")["client_secret"].alias("map_secret"), F.col("p.m")["lang"].alias("map_lang"),
    )


@query("fn_strip_html", f"SELECT plate_id, {STRIP_SQL} x FROM v_qa", ("v_qa",))
def fn_strip_html(t: Tables):
    return t.answers.select("plate_id", X.strip_html(F.col("html_answer"), 500).alias("x"))


@query("fn_symbol", "SELECT p_partkey, p_partkey::VARCHAR symbol FROM part")
def fn_symbol(t: Tables):
    return t.table("part").select("p_partkey", X.bare_symbol(F.concat(F.col("p_partkey").cast("string"), F.lit(".SZ.x"))).alias("symbol"))


@query("fn_zfill", "SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN lpad(p_partkey::VARCHAR,6,'0') WHEN p_partkey%3=0 THEN '-'||lpad(p_partkey::VARCHAR,5,'0') ELSE '1234567'||p_partkey END symbol FROM part")
def fn_zfill(t: Tables):
    i = F.col("p_partkey")
    raw = F.when(i % 2 == 0, i.cast("string")).when(i % 3 == 0, (-i).cast("string")).otherwise(F.concat(F.lit("1234567"), i.cast("string")))
    return t.table("part").select("p_partkey", X.zero_fill(raw).alias("symbol"))


@query("fn_sentiment_text", "SELECT news_id, CASE coalesce(sentiment,0) WHEN -1 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END x FROM v_news", ("v_news",))
def fn_sentiment_text(t: Tables):
    return t.news.select("news_id", X.sentiment_text(F.coalesce("sentiment", F.lit(0))).alias("x"))


@query("fn_to_timestamp", "SELECT id, strftime(try_cast(updated_at AS TIMESTAMP),'%Y-%m-%d %H:%M') x FROM v_plates", ("v_plates",))
def fn_to_timestamp(t: Tables):
    return t.plates.select("id", F.date_format(X.to_timestamp_or_null(F.col("updated_at")), "yyyy-MM-dd HH:mm").alias("x"))


@query("fn_round_text", "SELECT o_orderkey, printf('%.1f%%', round((o_orderkey%1000)/1000.0::DOUBLE*100,1)) pct, CASE WHEN o_orderkey%7>3 THEN '#2ecc71' ELSE '#e74c3c' END colour FROM orders")
def fn_round_text(t: Tables):
    i = F.col("o_orderkey")
    return t.table("orders").select(
        "o_orderkey", X.percent_text((i % 1000) / F.lit(1000.0)).alias("pct"), X.sign_colour(i % 7 - 3).alias("colour")
    )


@query("fn_clip", "SELECT o_orderkey, CASE WHEN o_orderkey%9<>0 THEN greatest(5,least(200,o_orderkey%300))::BIGINT END x FROM orders")
def fn_clip(t: Tables):
    i = F.col("o_orderkey")
    return t.table("orders").select("o_orderkey", X.clip(F.when(i % 9 != 0, i % 300), 5, 200).cast("bigint").alias("x"))


@query("fn_safe_name", "SELECT event_id, 'a-b-'||event_type x FROM events")
def fn_safe_name(t: Tables):
    return t.table("events").select("event_id", X.safe_name(F.concat(F.lit("a/b:"), "event_type")).alias("x"))


@query("fn_progress_parse", """SELECT event_id line_no, CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN event_id END AS "current", CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN 'plate '||event_type END AS name,
 CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN user_id END id, CASE WHEN event_id%5<>0 AND event_id%7<>0 THEN event_id%90 END stock_count FROM events""")
def fn_progress_parse(t: Tables):
    rows = _log_lines(t).select("line_no", X.progress_fields(F.col("line")).alias("p"))
    return rows.select("line_no", "p.current", "p.name", "p.id", "p.stock_count")
