"""Raw model text to a JSON object, and parse rules to typed columns.

Three places are tried for an object: the whole text, the first fenced block, the first balanced span.
Rows that Spark's own JSON parser can settle stay in the JVM. Only the rest is handed to one Arrow
``pandas_udf``, whose input is null for every settled row.
"""

from __future__ import annotations

import ast
import json
import math
import re
import sys
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import safe_float, strip_ws

# The UDF below carries its helpers along, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Marks that become plain JSON marks, and the fence pattern.
_DROPPED_MARKS = "\ufeff\u200b\u200c\u200d"
_WIDE_MARKS = "“”‘’，：｛｝［］"
_PLAIN_MARKS = "\"\"'',:{}[]"
_FENCE = r"```(?:json|JSON|javascript|js|python|py)?\s*([\s\S]*?)```"

_PLAIN_OF = dict(zip(_WIDE_MARKS, _PLAIN_MARKS)) | dict.fromkeys(_DROPPED_MARKS, "")
_ANY_MARK = re.compile(f"[{_WIDE_MARKS}{_DROPPED_MARKS}]")
_TRAILING_COMMA = r",(?:\s*,)*\s*([}\]])"
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f\ufeff\u200b-\u200d]"
_SENTINEL = "\u0001end-of-output"

REASONS = ("ok", "empty", "truncated", "invalid_json", "non_string")


def plain_marks(c: Column) -> Column:
    """Byte-order and zero-width marks removed, wide and curly marks replaced."""
    return F.translate(c, _WIDE_MARKS + _DROPPED_MARKS, _PLAIN_MARKS)


def fenced_block(c: Column) -> Column:
    """Body of the first fenced block, null when there is none."""
    return strip_ws(F.get(F.regexp_extract_all(c, F.lit(_FENCE), F.lit(1)), F.lit(0)))


def drop_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, _TRAILING_COMMA, "$1")


def _wrapped(text: Column) -> Column:
    """The text parsed as the first item of an array whose last item is a sentinel.

    ``try_parse_json`` ignores what follows the first value; here the sentinel comes second only if the text
    was exactly one value.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"\\u0001end-of-output"]')))


def _strict_object(wrapped: Column) -> Column:
    """VARIANT object when the *whole* wrapped text was one strict JSON object, else null."""
    body = F.try_variant_get(wrapped, "$[0]", "variant")
    return F.when(
        (F.try_variant_get(wrapped, "$[1]", "string") == F.lit(_SENTINEL))
        & F.startswith(F.schema_of_variant(body), F.lit("OBJECT")),
        body,
    )


# --- the residual tier: small pure helpers, one text at a time -------------------------------------------

# A string runs to its closing quote or, unclosed, to the end of the text.
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)'
_TOKEN = re.compile(_STRING + r"|[{}\[\]]", re.S)
_COMMENT_OR_STRING = re.compile("(" + _STRING + r")|//[^\r\n]*|/\*.*?(?:\*/|\Z)", re.S)


def _plain(text: str) -> str:
    # str.translate is many times slower on text beyond ASCII.
    return _ANY_MARK.sub(lambda m: _PLAIN_OF[m.group()], text)


def balanced_span(text: str) -> tuple[str | None, bool]:
    """First balanced ``{}``/``[]`` span and whether an opened span never closed."""
    open_marks: list[str] = []
    begin = 0
    for found in _TOKEN.finditer(text):
        mark = found.group()
        if mark in ("{", "["):
            if not open_marks:
                begin = found.start()
            open_marks.append("}" if mark == "{" else "]")
        elif mark in ("}", "]") and open_marks:
            if open_marks.pop() != mark:
                open_marks.clear()
            elif not open_marks:
                return text[begin : found.end()], False
    return None, bool(open_marks)


def _repair(text: str) -> str:
    if "//" in text or "/*" in text:
        text = _COMMENT_OR_STRING.sub(lambda m: m.group(1) or "", text)
    return re.sub(_TRAILING_COMMA, r"\1", text).strip()


def _as_object(reader: Any, text: str) -> dict | None:
    try:
        value = reader(text)
    except Exception:  # noqa: BLE001 - any unreadable text is simply not an object
        return None
    return value if isinstance(value, dict) else None


def _object_from(text: str, legacy_marks: bool) -> dict | None:
    plain = _plain(text)
    forms = [plain] if legacy_marks or plain == text else [text, plain]
    for form in forms:
        fixed = _repair(form)
        readings = [(json.loads, form), (json.loads, fixed), (ast.literal_eval, fixed)]
        for reader, candidate in readings[1:] if fixed == form else readings:
            value = _as_object(reader, candidate)
            if value is not None:
                return value
    return None


def _plain_json(value: Any) -> Any:
    """Only what strict JSON can hold: non-finite numbers and non-JSON literals become text."""
    if isinstance(value, dict):
        return {str(k): _plain_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_plain_json(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity")
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def parse_text(text: str | None, legacy_marks: bool = False) -> tuple[str | None, str, str]:
    """(JSON text or None, reason, strategy) of one output text."""
    if text is None:
        return None, "non_string", "none"
    shown = _plain(text).strip()
    if not shown:
        return None, "empty", "none"
    raw = shown if legacy_marks else text.strip().strip(_DROPPED_MARKS).strip()
    places = [("full_text", raw)]
    fence = re.search(_FENCE, raw)
    if fence and fence.group(1).strip():
        places.append(("fenced_block", fence.group(1).strip()))
    span, cut = balanced_span(shown)
    raw_span = span if raw == shown else balanced_span(raw)[0]
    places += [("balanced_extract", s) for s in dict.fromkeys((raw_span, span)) if s]
    for strategy, candidate in places:
        value = _object_from(candidate, legacy_marks)
        if value is not None:
            return json.dumps(_plain_json(value), ensure_ascii=False), "ok", strategy
    return (None, "truncated", "balanced_extract") if cut else (None, "invalid_json", "none")


_PARSED = "json string, reason string, strategy string"


def _residual_udf(legacy_marks: bool):
    @F.pandas_udf(_PARSED)
    def residual(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_text(t, legacy_marks) if t is not None else (None, None, None) for t in texts]
        return pd.DataFrame(rows, columns=["json", "reason", "strategy"], dtype=object)

    return residual


def parse_outputs(
    df: DataFrame, text: str = "output_text", out: str = "parse", legacy_marks: bool = False, native: bool = True
) -> DataFrame:
    """Add a struct column (data VARIANT, reason, strategy).

    Strict parsing of the raw text comes before any mark replacement, so a valid object keeps its values;
    ``legacy_marks`` replaces marks first. ``native=False`` sends every row through the UDF tier.
    """
    source = strip_ws(plain_marks(F.col(text))) if legacy_marks else strip_ws(F.col(text))
    # Blank: nothing but white space and dropped marks; the search ends at the first other character.
    work = df.withColumn("_raw", source).withColumn("_blank", ~F.col(text).rlike(_NOT_BLANK))
    if native:
        raw = F.col("_raw")
        braced = F.startswith(raw, F.lit("{"))
        # A text that starts with a letter or a fence can be neither JSON nor a literal as a whole.
        fence_first = F.left(raw, F.lit(3)).rlike(r"^(```|\p{L})") & raw.contains("```")
        no_comments = ~raw.contains("//") & ~raw.contains("/*")
        # Each parse is its own projection, so that it is made once and then read several times.
        work = work.withColumn("_w", F.when(braced, _wrapped(raw)).when(fence_first, _wrapped(fenced_block(raw))))
        work = work.withColumn("_strict", _strict_object(F.col("_w"))).drop("_w")
        again = F.col("_strict").isNull() & braced & no_comments & raw.rlike(_TRAILING_COMMA)
        work = work.withColumn("_w", F.when(again, _wrapped(drop_trailing_commas(raw))))
        work = work.withColumn("_object", F.coalesce("_strict", _strict_object(F.col("_w")))).drop("_w", "_strict")
    else:
        work = work.withColumn("_object", F.lit(None).cast("variant"))
    unread, blank, settled = F.col(text).isNull(), F.col("_blank"), F.col("_object").isNotNull()
    # Rows settled here, and empty ones, reach the UDF as null.
    work = work.withColumns({
        "_how": F.when(unread, "non_string").when(blank, "empty").when(settled & F.startswith("_raw", F.lit("{")), "full_text")
        .when(settled, "fenced_block"),
    })
    work = work.withColumn("_rest", _residual_udf(legacy_marks)(F.when(F.col("_how").isNull(), F.col(text))))
    how = F.col("_how")
    failed = how.isin("non_string", "empty")
    parsed = F.struct(
        F.coalesce("_object", F.try_parse_json(F.col("_rest.json"))).alias("data"),
        F.when(failed, how).when(how.isNotNull(), "ok").otherwise(F.col("_rest.reason")).alias("reason"),
        F.when(failed, "none").when(how.isNotNull(), how).otherwise(F.col("_rest.strategy")).alias("strategy"),
    )
    return work.select(*df.columns, parsed.alias(out))


# --- field rules -----------------------------------------------------------------------------------------

def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def _raw_value(data: Column, field: str) -> Column:
    return F.try_variant_get(data, _path(field), "variant")


def _kind(value: Column) -> Column:
    """Type name of a VARIANT value; null when the field is absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def field_str(data: Column, field: str, default: str = "") -> Column:
    """Text of the field; empty, zero, false and null count as missing."""
    value = _raw_value(data, field)
    text = _text(value)
    empty = text.isNull() | text.isin("", "0", "0.0", "false", "[]", "{}", "-0.0") & (
        (_kind(value) != "STRING") | (text == "")
    )
    return F.when(empty, F.lit(default)).otherwise(text)


def _items(data: Column, field: str) -> Column:
    return F.try_variant_get(data, _path(field), "array<variant>")


def field_list(data: Column, field: str, max_len: int | None = None) -> Column:
    """Items as text (JSON text for anything that is not text); anything but a list gives an empty one."""
    items = F.coalesce(_items(data, field), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")))
    return F.slice(texts, 1, max_len) if max_len else texts


def field_enum(data: Column, field: str, values: list[str], default: str) -> Column:
    value = _raw_value(data, field)
    text = _text(value)
    return F.when((_kind(value) == "STRING") & text.isin(*values), text).otherwise(F.lit(default))


def _number(value: Column) -> Column:
    """Numbers as double and booleans as 0/1; null for other kinds."""
    text, kind = _text(value), _kind(value)
    return F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(
        kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), text.try_cast("double")
    )


def field_int(data: Column, field: str, default: int, lo: int, hi: int) -> Column:
    """Whole number, clamped. Fractions are cut; text must be a whole number; the default is clamped too."""
    if not -(2**31) <= lo <= hi < 2**31:
        raise ValueError(f"{field}: bounds must be ordered whole numbers of 32 bits")
    value = _raw_value(data, field)
    text = F.trim(_text(value))
    # Wider than 18 digits is far beyond any range in use: keep the sign and let the clamp decide.
    digits = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    typed = F.when(digits.rlike(r"^[+-]?\d{1,18}$"), digits.try_cast("bigint")).when(
        digits.rlike(r"^[+-]?\d+$"), F.when(F.startswith(digits, F.lit("-")), F.lit(-(2**62))).otherwise(F.lit(2**62))
    )
    number = _number(value)
    whole = F.when(_kind(value) == "STRING", typed).when(
        number.isNotNull(), F.greatest(F.least(number, F.lit(float(2**62))), F.lit(-float(2**62))).cast("bigint")
    )
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(whole, F.lit(default)))).cast("int")


def field_float(data: Column, field: str, default: float, lo: float | None = None, hi: float | None = None) -> Column:
    value = _raw_value(data, field)
    raw = F.coalesce(F.when(_kind(value) == "STRING", safe_float(_text(value))).otherwise(_number(value)), F.lit(float(default)))
    out = raw
    if lo is not None:
        out = F.when(F.isnan(raw), F.lit(float(lo))).otherwise(F.greatest(F.lit(float(lo)), out))
    if hi is not None:
        out = F.when(F.isnan(out), F.lit(float(hi))).otherwise(F.least(F.lit(float(hi)), out))
    return out


def field_list_raw(data: Column, field: str) -> Column:
    return F.coalesce(_items(data, field), F.array().cast("array<variant>"))


def field_any(data: Column, field: str, default: Any = 0) -> Column:
    """The value as it is; a present null stays, an absent field takes the default."""
    fallback = F.try_parse_json(F.lit(json.dumps(default, ensure_ascii=False)))
    return F.coalesce(_raw_value(data, field), fallback)


def _field(data: Column, rule: dict[str, Any]) -> Column:
    name, kind = rule["field"], rule.get("type", "str")
    default = rule.get("default", "" if kind == "str" else 0)
    if kind == "str":
        return field_str(data, name, str(default))
    if kind == "int":
        return field_int(data, name, int(default), int(rule.get("lo", -(10**9))), int(rule.get("hi", 10**9)))
    if kind == "float":
        return field_float(data, name, float(default), rule.get("lo"), rule.get("hi"))
    if kind == "enum":
        return field_enum(data, name, list(rule.get("values", [])), str(default))
    if kind == "list":
        return field_list(data, name, rule.get("max_len"))
    if kind == "list_raw":
        return field_list_raw(data, name)
    return field_any(data, name, default)


def apply_schema(data: Column, rules: list[dict[str, Any]] | tuple[dict[str, Any], ...]) -> Column:
    """One struct column from all field rules; null when there is no object."""
    return F.when(data.isNotNull(), F.struct(*[_field(data, r).alias(r["field"]) for r in rules]))
