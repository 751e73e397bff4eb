"""Metric builders over scored rows.

A scored row has two struct columns, ``parsed`` (the model's object, null when unparsed) and ``sample``
(the labelled input); they stay apart because both sides may use the same field names. A builder takes a
rule and a :class:`Sides` view and returns named double columns, all of them computed within the row.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text import normalize_text, safe_float, strip_ws
from scorelake.spec import MetricRule

# The token-counting UDF carries its helpers along, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Named = list[tuple[str, Column]]
_TEXT_KEYS = ("text", "summary", "rationale", "analysis", "content", "conclusion", "reason", "claim")


class Sides:
    """Typed access to the two sides of a scored row."""

    def __init__(self, schema: T.StructType, parsed: str = "parsed", sample: str = "sample"):
        self._types = {"parsed": schema[parsed].dataType, "sample": schema[sample].dataType}
        self._cols = {"parsed": F.col(parsed), "sample": F.col(sample)}

    @property
    def has_parsed(self) -> Column:
        return self._cols["parsed"].isNotNull()

    def pick(self, side: str, name: str | None) -> tuple[Column, T.DataType]:
        """Column and type of a field; an absent field is a typed null."""
        struct = self._types[side]
        if name and name in struct.fieldNames():
            return self._cols[side][name], struct[name].dataType
        return F.lit(None).cast("string"), T.NullType()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``: it becomes the one item of a mapped list."""
    return F.transform(F.array(value), body)[0]


# --- shared pieces ---------------------------------------------------------------------------------------

def as_double(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return safe_float(c)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.VariantType):
        return safe_float(F.try_variant_get(c, "$", "string"))
    return F.lit(None).cast("double")


def as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(c, "$", "string")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _norm(c: Column, dtype: T.DataType, normalize: bool) -> Column:
    return normalize_text(c) if normalize and isinstance(dtype, T.StringType) else c


def distinct_items(c: Column, dtype: T.DataType, normalize: bool) -> Column:
    """Distinct list items as text, nulls kept as one item; a non-list gives an empty list."""
    if not isinstance(dtype, T.ArrayType):
        return F.array().cast("array<string>")
    def one(x: Column) -> Column:
        text = as_text(x, dtype.elementType)
        return normalize_text(text) if normalize and isinstance(dtype.elementType, T.StringType) else text
    return F.array_distinct(F.transform(F.coalesce(c, F.array().cast(dtype)), one))


def string_set(c: Column, dtype: T.DataType, normalize: bool) -> Column:
    """Distinct non-blank strings of a text, a list of texts, or a list of objects with ``id``."""
    empty = F.array().cast("array<string>")
    clean = (lambda x: normalize_text(x)) if normalize else (lambda x: x)
    if isinstance(dtype, T.StringType):
        texts = F.when(c.isNotNull(), F.array(clean(c)))
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        texts = F.transform(c, clean)
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and "id" in dtype.elementType.fieldNames():
        texts = F.transform(c, lambda x: clean(x["id"].cast("string")))
    elif isinstance(dtype, T.VariantType):
        texts = F.transform(_variant_strings(c), clean)
    else:
        return empty
    return F.coalesce(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))), empty)


def _variant_strings(v: Column) -> Column:
    """Strings of a VARIANT that is a text, or a list of texts and objects with ``id``."""
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    one = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(
        kind(x) == "OBJECT", F.try_variant_get(x, "$.id", "string")
    )
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(kind(v) == "STRING", F.array(one(v))).otherwise(F.transform(items, one))


def text_fragments(c: Column, dtype: T.DataType) -> Column:
    """Non-blank texts under the known text keys, in key order, for a column of known type, at any depth."""
    empty = F.array().cast("array<string>")
    keep = lambda a: F.filter(a, lambda x: x.isNotNull() & (strip_ws(x) != ""))
    if isinstance(dtype, T.StringType):
        return keep(F.array(c))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: text_fragments(x, dtype.elementType))), empty)
    if isinstance(dtype, T.StructType):
        found = [text_fragments(c[k], dtype[k].dataType) for k in _TEXT_KEYS if k in dtype.fieldNames()]
        return F.concat(*found) if found else empty
    if isinstance(dtype, T.VariantType):
        return keep(F.coalesce(_json_fragments()(F.to_json(c)), empty))
    return empty


def _json_fragments():
    """As above for JSON text, whose shape is known at run time only: the whole value is walked, without recursion."""
    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([_walked(json.loads(t)) if t else [] for t in texts])

    return walk


def _walked(value) -> list[str]:
    out, waiting = [], [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            waiting += reversed(x)
        elif isinstance(x, dict):
            waiting += [x[k] for k in reversed(_TEXT_KEYS) if k in x]
    return out


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))


def precision_recall(inter: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    """Unrounded precision, recall and F1 from three counts."""
    p, r = _share(inter, n_pred), _share(inter, n_true)
    f1 = F.when((p + r) > 0, (F.lit(2) * p * r) / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))
    return p, r, f1


def _overlap(name: str, pred: Column, truth: Column) -> Named:
    inter, n_pred, n_true = F.size(F.array_intersect(pred, truth)), F.size(pred), F.size(truth)
    def score(c: Column) -> Column:
        both_empty = (c["p"] == 0) & (c["t"] == 0)
        values = precision_recall(c["i"], c["p"], c["t"])
        return F.array(*[F.when(both_empty, F.lit(1.0)).otherwise(F.round(v, 4)) for v in values])

    scores = let(F.struct(inter.alias("i"), n_pred.alias("p"), n_true.alias("t")), score)
    return [(f"{name}_{tag}", scores[i]) for i, tag in enumerate(("precision", "recall", "f1"))]


# --- builders --------------------------------------------------------------------------------------------

def field_completeness(rule: MetricRule, sides: Sides) -> Named:
    fields = list(rule.get("fields", []))
    if not fields:
        return [("field_completeness", F.lit(0.0))]
    filled = F.lit(0)
    for name in fields:
        value, dtype = sides.pick("parsed", name)
        if isinstance(dtype, T.StringType):
            ok = strip_ws(value) != ""
        elif isinstance(dtype, T.ArrayType):
            ok = F.size(value) > 0
        else:
            ok = value.isNotNull()
        filled = filled + F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0)
    share = F.round(filled / len(fields), 4)
    return [("field_completeness", F.when(sides.has_parsed, share).otherwise(F.lit(0.0)))]


def custom_ratio(rule: MetricRule, sides: Sides) -> Named:
    name = rule.name or "ratio"
    if "denominator_fixed" in rule.options:
        denom = F.lit(float(rule.get("denominator_fixed") or 1))
    else:
        value, dtype = sides.pick("sample", rule.get("denominator_sample_field"))
        if isinstance(dtype, T.ArrayType):
            denom = F.coalesce(F.size(value), F.lit(0)).cast("double")
        elif isinstance(dtype, T.NullType):
            denom = F.lit(0.0)
        else:
            # Text that is no number cannot be a denominator: the metric is null and the row an error, see scoring_error().
            denom = F.when(value.isNull() | (as_text(value, dtype) == ""), F.lit(1.0)).otherwise(as_double(value, dtype))
    number, dtype = sides.pick("parsed", rule.get("numerator_field"))
    numerator = F.abs(F.coalesce(as_double(number, dtype), F.lit(0.0)))
    return [(name, F.round(numerator / F.when(denom.isNotNull(), F.greatest(denom, F.lit(1.0))), 4))]


def _bad_denominator(rule: MetricRule, sides: Sides) -> Column | None:
    field = rule.get("denominator_sample_field")
    if "denominator_fixed" in rule.options or not field:
        return None
    value, dtype = sides.pick("sample", field)
    if isinstance(dtype, (T.ArrayType, T.NullType)):
        return None
    text = as_text(value, dtype)
    return F.when(value.isNotNull() & (text != "") & as_double(value, dtype).isNull(), F.concat(
        F.lit("metrics_error: could not convert to a number: "), text))


def scoring_error(schema: T.StructType, rules: list[MetricRule], parsed: str, sample: str) -> Column:
    """Message of the first rule that cannot be computed for a row, null where all can."""
    sides = Sides(schema, parsed, sample)
    found = [e for r in rules if r.type == "custom_ratio" and (e := _bad_denominator(r, sides)) is not None]
    return F.coalesce(*found, F.lit(None).cast("string"))


def exact_match(rule: MetricRule, sides: Sides) -> Named:
    name = rule.name or f"{rule.get('pred_field', '')}_exact_match"
    normalize = bool(rule.get("normalize", True))
    pred, pred_type = sides.pick("parsed", rule.get("pred_field"))
    label, label_type = sides.pick("sample", rule.get("label_field"))
    numbers = all(isinstance(t, (T.NumericType, T.BooleanType)) for t in (pred_type, label_type))
    if numbers:
        same = pred.cast("double").eqNullSafe(label.cast("double"))
    elif pred_type == label_type or isinstance(pred_type, T.NullType) or isinstance(label_type, T.NullType):
        same = _norm(as_text(pred, pred_type), pred_type, normalize).eqNullSafe(
            _norm(as_text(label, label_type), label_type, normalize)
        )
    else:
        # Values of different kinds are equal only when both are missing.
        same = pred.isNull() & label.isNull()
    return [(name, F.when(same, 1.0).otherwise(0.0))]


def numeric_error(rule: MetricRule, sides: Sides) -> Named:
    name = rule.name or rule.get("pred_field") or "numeric"
    pred = as_double(*sides.pick("parsed", rule.get("pred_field")))
    label = as_double(*sides.pick("sample", rule.get("label_field")))
    error = F.abs(pred - label)
    out = [(f"{name}_mae", F.round(error, 6))]
    tolerance = rule.get("tolerance")
    if tolerance is not None:
        hit = error <= F.lit(max(0.0, float(tolerance)))
        out.append((f"{name}_within_tol", F.when(hit, 1.0).otherwise(0.0)))
    return out


def list_overlap(rule: MetricRule, sides: Sides) -> Named:
    normalize = bool(rule.get("normalize", True))
    pred = distinct_items(*sides.pick("parsed", rule.get("pred_field")), normalize)
    truth = distinct_items(*sides.pick("sample", rule.get("label_field")), normalize)
    return _overlap(rule.name or rule.get("pred_field") or "list", pred, truth)


def reasoning_consistency(rule: MetricRule, sides: Sides) -> Named:
    name, normalize = rule.name or "reasoning", bool(rule.get("normalize", True))
    answer, dtype = sides.pick("parsed", rule.get("final_answer_field", "final_answer"))
    if isinstance(dtype, T.StructType):
        answer = answer["value"] if "value" in dtype.fieldNames() else F.lit("")
        dtype = dict((f.name, f.dataType) for f in dtype.fields).get("value", T.StringType())
    text = strip_ws(as_text(answer, dtype))
    if isinstance(dtype, T.NumericType):
        text = F.when(answer != 0, text)
    support = F.concat(*[
        F.coalesce(text_fragments(*sides.pick("parsed", f)), F.array().cast("array<string>"))
        for f in rule.get("support_fields", ["steps", "claims", "rationale"])
    ])
    # The fragments and the answer are put in their compared form once, and both scores read the same two counts.
    norm = normalize_text if normalize else (lambda c: c)
    counts = let(F.struct(norm(text).alias("target"), F.transform(support, norm).alias("support")), lambda c: F.struct(
        F.size(F.filter(c["support"], lambda s: F.contains(s, c["target"]))).alias("hits"), F.size(c["support"]).alias("n")))
    usable = sides.has_parsed & text.isNotNull() & (text != "")

    def score(c: Column) -> Column:
        live = usable & (c["n"] > 0)
        return F.array(F.when(live & (c["hits"] > 0), 1.0).otherwise(0.0), F.when(live, F.round(c["hits"] / F.nullif(c["n"], F.lit(0)), 4)).otherwise(0.0))

    scores = let(counts, score)
    return [(f"{name}_consistency", scores[0]), (f"{name}_support_coverage", scores[1])]


def longest_rising(values: Column) -> Column:
    """Length of the longest strictly rising subsequence of a list of whole numbers without nulls.

    The state has, for every length, the least number that such a run can end with; a number takes the place of the first that is not less.
    """
    kind = "array<int>"
    def step(ends: Column, v: Column) -> Column:
        return let(F.struct(ends.alias("ends"), F.size(F.filter(ends, lambda e: e < v)).alias("k")), lambda s: F.concat(
            F.slice(s["ends"], F.lit(1), s["k"]), F.array(v), F.slice(s["ends"], s["k"] + 2, F.greatest(F.size(s["ends"]) - s["k"] - 1, F.lit(0)))))

    return F.size(F.aggregate(values.cast(kind), F.array().cast(kind), step))


def reasoning_step_order(rule: MetricRule, sides: Sides) -> Named:
    """Order and completeness of the steps against a reference chain.

    A step stands for the first reference step with the same text. ``_order`` is the share of matched steps that are in the reference's order (the longest rising run of their places,
    repeats once), ``_completeness`` the share of different reference steps that were matched; both are 0 where nothing matches or a side is empty.
    """
    name, normalize = rule.name or "steps", bool(rule.get("normalize", True))
    empty = F.array().cast("array<string>")
    fragments = lambda side, field: F.coalesce(text_fragments(*sides.pick(side, field)), empty)
    norm = (lambda a: F.transform(a, normalize_text)) if normalize else (lambda a: a)
    steps = norm(fragments("parsed", rule.get("steps_field", "steps")))
    chain = F.array_distinct(norm(fragments("sample", rule.get("label_field", "gt_steps"))))
    places = let(F.struct(steps.alias("steps"), chain.alias("chain")), lambda c: F.struct(
        F.filter(F.transform(c["steps"], lambda s: F.array_position(c["chain"], s).cast("int")), lambda p: p > 0).alias("at"), F.size(c["chain"]).alias("n")))
    scores = let(places, lambda c: F.array(
        F.round(_share(longest_rising(c["at"]).cast("double"), F.size(c["at"])), 4), F.round(_share(F.size(F.array_distinct(c["at"])).cast("double"), c["n"]), 4)))
    return [(f"{name}_order", scores[0]), (f"{name}_completeness", scores[1])]


def union_evidence(claims: Column, dtype: T.DataType, key: str, normalize: bool) -> Column:
    """Union of the evidence ids over all claims; a claim that is plain text is its own id."""
    empty = F.array().cast("array<string>")
    if not isinstance(dtype, T.ArrayType):
        return empty
    item = dtype.elementType
    if isinstance(item, T.StructType) and key in item.fieldNames():
        sets = F.transform(claims, lambda c: string_set(c[key], item[key].dataType, normalize))
        return F.coalesce(F.array_distinct(F.flatten(sets)), empty)
    if isinstance(item, T.VariantType):
        def of_claim(c: Column) -> Column:
            is_object = F.startswith(F.schema_of_variant(c), F.lit("OBJECT"))
            source = F.when(is_object, F.try_variant_get(c, f"$.{key}", "variant")).when(
                F.schema_of_variant(c) == "STRING", c
            )
            return string_set(source, item, normalize)

        return F.coalesce(F.array_distinct(F.flatten(F.transform(claims, of_claim))), empty)
    return string_set(claims, dtype, normalize) if isinstance(item, T.StringType) else empty


def claim_evidence_overlap(rule: MetricRule, sides: Sides) -> Named:
    normalize = bool(rule.get("normalize", True))
    claims, dtype = sides.pick("parsed", rule.get("claims_field", "claims"))
    pred = union_evidence(claims, dtype, rule.get("claim_evidence_key", "evidence"), normalize)
    truth = string_set(*sides.pick("sample", rule.get("label_field", "gt_evidence_ids")), normalize)
    return _overlap(rule.name or "evidence", pred, truth)


Builder = Callable[[MetricRule, Sides], Named]
BUILDERS: dict[str, Builder] = {
    "field_completeness": field_completeness,
    "custom_ratio": custom_ratio,
    "exact_match": exact_match,
    "numeric_error": numeric_error,
    "list_overlap": list_overlap,
    "reasoning_consistency": reasoning_consistency,
    "claim_evidence_overlap": claim_evidence_overlap,
    "reasoning_step_order": reasoning_step_order,
}


def register_metric(name: str, builder: Builder) -> None:
    """Add a metric type; the builder may use any Column, a ``pandas_udf`` call included."""
    BUILDERS[name] = builder


def known_metric_types() -> list[str]:
    return sorted(BUILDERS)


# --- ROUGE-1 ---------------------------------------------------------------------------------------------

# The public default tokens (ASCII letters and digits), and a form that also keeps CJK signs.
_TOKENS = {"ascii": r"[a-z0-9]+", "char": r"[a-z0-9]+|[^\W\d_a-z]"}


def _token_counts(tokenizer: str):
    @F.pandas_udf("shared long, hyp long, ref long")
    def counts(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        find = re.compile(_TOKENS[tokenizer]).findall
        rows = []
        for h, r in zip(hyp, ref):
            mine, theirs = Counter(find((h or "").lower())), Counter(find((r or "").lower()))
            rows.append(((mine & theirs).total(), mine.total(), theirs.total()))
        return pd.DataFrame(rows, columns=["shared", "hyp", "ref"], dtype="int64")

    return counts


def rouge1(hypothesis: Column, reference: Column, tokenizer: str = "ascii") -> Column:
    """Unigram F1, rounded; 0 where a side is missing or has no token.

    Both texts are already in the row, so nothing is shuffled. Counting tokens is the one metric step done in
    an Arrow UDF: it was measured at well under half the time of the same count by higher-order functions,
    and an explode with grouped counts would send every token through a shuffle.
    """
    counts = _token_counts(tokenizer)(hypothesis, reference)
    return F.round(precision_recall(counts["shared"], counts["hyp"], counts["ref"])[2], 4)


def reference_rouge(rule: MetricRule, sides: Sides) -> Named:
    hyp = as_text(*sides.pick("parsed", rule.get("output_field", "summary")))
    ref = as_text(*sides.pick("sample", rule.get("reference_field", "reference_summary")))
    return [("rouge1", rouge1(hyp, ref, rule.get("tokenizer", "ascii")))]


BUILDERS["reference_rouge"] = reference_rouge


# --- applying rules --------------------------------------------------------------------------------------

def metric_columns(schema: T.StructType, rules: list[MetricRule] | tuple[MetricRule, ...],
                   parsed: str = "parsed", sample: str = "sample") -> Named:
    """Named columns of all per-row rules; rules of an unknown type add nothing (see unknown_metric_types)."""
    sides = Sides(schema, parsed, sample)
    named: dict[str, Column] = {}
    for rule in rules:
        if rule.type in BUILDERS:
            named.update(BUILDERS[rule.type](rule, sides))
    return list(named.items())


def task_metrics(schema: T.StructType, rules: list[MetricRule] | tuple[MetricRule, ...],
                 parsed: str = "parsed", sample: str = "sample") -> Column:
    """Ordered name/value list of all rules for rows with a parsed and a sample struct column."""
    items = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in metric_columns(schema, rules, parsed, sample)]
    return F.array(*items) if items else F.array().cast("array<struct<name:string,value:double>>")


def overlap_counts(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """Unrounded overlap of two list columns, items compared as they are, with the counts behind it."""
    p, t = F.array_distinct(pred), F.array_distinct(truth)
    rows = df.withColumns({
        "pred_count": F.size(p), "gt_count": F.size(t), "match_count": F.size(F.array_intersect(p, t))
    })
    precision, recall, f1 = precision_recall(F.col("match_count"), F.col("pred_count"), F.col("gt_count"))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": f1})


def overlap_counts_long(pred: DataFrame, truth: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The same from one row per item, for lists too long for a column: both sides are de-duplicated and counted."""
    flagged = pred.select(*keys, item, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(
        truth.select(*keys, item, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    )
    per_item = flagged.groupBy(*keys, item).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    rows = per_item.groupBy(*keys).agg(
        F.sum("_p").alias("pred_count"), F.sum("_t").alias("gt_count"),
        F.sum(F.col("_p") * F.col("_t")).alias("match_count"),
    )
    precision, recall, f1 = precision_recall(F.col("match_count"), F.col("pred_count"), F.col("gt_count"))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": f1})
