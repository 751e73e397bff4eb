"""Output parser and field rules."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import outputs as O

CASES = [
    ('Sure:\n```json\n{"a": 1, "b": "x"}\n```\nbye', {"a": 1, "b": "x"}, "ok", "fenced_block"),
    ('{"a": 1, "b": [1,2,],}', {"a": 1, "b": [1, 2]}, "ok", "full_text"),
    ("{'a': 1, 'b': 'ok', 'flag': True}", {"a": 1, "b": "ok", "flag": True}, "ok", "full_text"),
    ("｛“a”：1，/*note*/“b”：2｝", {"a": 1, "b": 2}, "ok", "full_text"),
    ('{"a":"hello"', None, "truncated", "balanced_extract"),
    ("  \n\t ", None, "empty", "none"),
    ("﻿​", None, "empty", "none"),
    ("totally not json", None, "invalid_json", "none"),
    (None, None, "non_string", "none"),
    ('{"a": 1} {"b": 2}', {"a": 1}, "ok", "balanced_extract"),
    ('{"a": 1}, {"b": 2}', {"a": 1}, "ok", "balanced_extract"),
    ('{"a": 1}],[{"b": 2}', {"a": 1}, "ok", "balanced_extract"),
    ('{"a": 1, "a": 2}', {"a": 2}, "ok", "full_text"),
    ('[1, 2] then {"a": 1}', None, "invalid_json", "none"),
    ('x ] {"a": 1}', {"a": 1}, "ok", "balanced_extract"),
    ('{"t": "， stays wide"}', {"t": "， stays wide"}, "ok", "full_text"),
    ('{"u": "http://x/*y*/", // c\n "v": 1}', {"u": "http://x/*y*/", "v": 1}, "ok", "full_text"),
    ("```\n[1]\n```", None, "invalid_json", "none"),
    ('say "{" first {"a": 1}', {"a": 1}, "ok", "balanced_extract"),
    ('open " quote {"a": 1}', None, "invalid_json", "none"),
    ("null", None, "invalid_json", "none"),
]


def _run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, output_text string")
    out = O.parse_outputs(df, **kw).select("i", F.to_json("parse.data").alias("j"), "parse.reason", "parse.strategy")
    return [(json.loads(r.j) if r.j else None, r.reason, r.strategy) for r in out.orderBy("i").collect()]


@pytest.mark.parametrize("native", [True, False])
def test_parser_cases(spark, native):
    got = _run(spark, [c[0] for c in CASES], native=native)
    for case, result in zip(CASES, got):
        assert result == case[1:], case[0]


def test_legacy_marks_change_values(spark):
    assert _run(spark, ['{"t": "，"}'], legacy_marks=True)[0][0] == {"t": ","}


def test_non_finite_numbers_survive_as_text(spark):
    assert _run(spark, ['{"a": NaN, "b": -Infinity}'])[0][0] == {"a": "NaN", "b": "-Infinity"}


def test_tiers_agree_on_mixed_texts(spark):
    bits = ['{"a": 1}', "{", "}", ",", "```json\n", "\n```", '"', "'k': 2", "// x\n", "/* y */", "[", "]", "：", " word ", '{"k": [1,],}']
    texts = [a + b + c for a in bits for b in bits for c in bits[:6]]
    assert _run(spark, texts) == _run(spark, texts, native=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",\\ ab\'/*', max_size=40))
def test_balanced_span_is_balanced(text):
    span, cut = O.balanced_span(text)
    if span is not None:
        assert not cut and span in text and span[0] in "{[" and span[-1] in "}]"


FIELDS = [
    ('{"x": 3.7}', 3), ('{"x": "3.7"}', 1), ('{"x": " 4 "}', 4), ('{"x": true}', 1), ('{"x": null}', 1), ("{}", 1), ('{"x": [1]}', 1),
    ('{"x": 99}', 5), ('{"x": -99}', -5), ('{"x": 1e30}', 5), ('{"x": "1_0"}', 5), ('{"x": "-99999999999999999999"}', -5),
]


def test_int_field(spark):
    df = spark.createDataFrame([(t,) for t, _ in FIELDS], "t string")
    got = [r.v for r in df.select(O.field_int(F.try_parse_json("t"), "x", 1, -5, 5).alias("v")).collect()]
    assert got == [v for _, v in FIELDS]


def test_str_list_enum_float_fields(spark):
    rows = ['{"x": 0}', '{"x": "0"}', '{"x": {"a": 1}}', '{"x": ["a", 1, null]}', '{"x": "nan"}', '{"x": "b"}']
    d = F.try_parse_json("t")
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(
        O.field_str(d, "x", "-").alias("s"), O.field_list(d, "x", 2).alias("l"), O.field_enum(d, "x", ["b", "0"], "z").alias("e"),
        O.field_float(d, "x", 9.0, 0.0, 5.0).alias("f"),
    )
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["-", "0", '{"a":1}', '["a",1,null]', "nan", "b"]
    assert [g[1] for g in got] == [[], [], [], ["a", "1"], [], []]
    assert [g[2] for g in got] == ["z", "0", "z", "z", "z", "b"]
    assert [g[3] for g in got] == [0.0, 0.0, 5.0, 5.0, 0.0, 5.0]


def test_apply_schema_is_null_without_an_object(spark):
    df = spark.createDataFrame([("[1]",), ('{"a": "q"}',)], "output_text string")
    out = O.parse_outputs(df).select(O.apply_schema(F.col("parse.data"), [{"field": "a"}, {"field": "n", "type": "int"}]).alias("p"))
    assert [r.p and tuple(r.p) for r in out.collect()] == [None, ("q", 0)]
