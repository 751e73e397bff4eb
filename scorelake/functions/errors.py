"""Error taxonomy: message text to (type, stage, code), and the rule that picks the final triple."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (words that must all occur, type, stage, code); the first match wins.
ERROR_RULES = (
    (("build_prompt_error",), "prompt_build_failure", "build_prompt", "build_prompt_error"),
    (("gateway_error", "timeout"), "timeout", "gateway", "gateway_timeout"),
    (("gateway_error", "rate limit"), "rate_limit", "gateway", "gateway_rate_limit"),
    (("gateway_error", "429"), "rate_limit", "gateway", "gateway_rate_limit"),
    (("gateway_error", "refusal"), "refusal", "gateway", "gateway_refusal"),
    (("gateway_error", "safety"), "refusal", "gateway", "gateway_refusal"),
    (("gateway_error",), "gateway_failure", "gateway", "gateway_error"),
    (("parse_error",), "parse_failure", "parse", "parse_error"),
    (("metrics_error",), "metrics_failure", "metrics", "metrics_error"),
    (("upstream_", "_missing"), "upstream_missing", "upstream", "upstream_missing"),
    (("upstream_", "_parse_failed"), "upstream_parse_failed", "upstream", "upstream_parse_failed"),
)
UNKNOWN = ("unknown_error", "unknown", "unknown_error")
SCHEMA_MISMATCH = ("schema_mismatch", "parse", "parse_empty_or_invalid")


def _triple(kind: str, stage: str, code: str) -> Column:
    return F.struct(
        F.lit(kind).alias("error_type"), F.lit(stage).alias("error_stage"), F.lit(code).alias("error_code")
    )


def classify_error(message: Column) -> Column:
    """Struct (error_type, error_stage, error_code); all blank for a blank message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(F.trim(text) == "", _triple("", "", ""))
    for words, kind, stage, code in ERROR_RULES:
        hit = F.lit(True)
        for word in words:
            hit = hit & text.contains(word)
        out = out.when(hit, _triple(kind, stage, code))
    return out.otherwise(_triple(*UNKNOWN))


def derive_error(
    success: Column,
    parse_applicable: Column,
    parse_success: Column,
    message: Column,
    error_type: Column | None = None,
    error_stage: Column | None = None,
    error_code: Column | None = None,
) -> Column:
    """Struct with the final triple plus ``error_detail``.

    Recorded fields count only when all three are filled; otherwise the message is classified. A failed
    row never stays untyped, and an answered but unparsed row becomes a schema mismatch.
    """
    blank = F.lit("")
    t, s, k = (F.coalesce(c, blank) if c is not None else blank for c in (error_type, error_stage, error_code))
    recorded = (t != "") & (s != "") & (k != "")
    base = F.when(
        recorded, F.struct(t.alias("error_type"), s.alias("error_stage"), k.alias("error_code"))
    ).otherwise(classify_error(message))
    untyped = base["error_type"] == ""
    final = (
        F.when(~success & untyped, _triple(*UNKNOWN))
        .when(success & parse_applicable & ~parse_success & untyped, _triple(*SCHEMA_MISMATCH))
        .otherwise(base)
    )
    return F.struct(
        final["error_type"].alias("error_type"),
        final["error_stage"].alias("error_stage"),
        final["error_code"].alias("error_code"),
        F.coalesce(message, blank).alias("error_detail"),
    )


def append_error(first: Column, second: Column) -> Column:
    """Join two messages with ``; ``; blanks take no part."""
    return F.concat_ws("; ", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
