"""Cost, cache keys and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names whose content is hidden.
SECRET_NAMES = (
    "api_key", "apikey", "secret", "secret_key", "secretkey", "password", "passwd", "token", "access_token",
    "refresh_token", "credential", "auth", "authorization", "auth_token",
)
SECRET_SUFFIXES = ("_key", "_secret", "_token", "_password", "_credential")
MASK = "***"


def call_cost(prompt_tokens: Column, completion_tokens: Column, price: Column, from_cache: Column) -> Column:
    """Cost by price per thousand tokens; 0 without a price and 0 for a cache hit. ``price`` is a struct."""
    per_1k = lambda tokens, rate: F.coalesce(tokens, F.lit(0)) / F.lit(1000.0) * F.coalesce(rate, F.lit(0.0))
    paid = per_1k(prompt_tokens, price["input_per_1k"]) + per_1k(completion_tokens, price["output_per_1k"])
    return F.when(F.coalesce(from_cache, F.lit(False)), F.lit(0.0)).otherwise(F.round(paid, 8))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def cache_key(model_id: Column, model_params: Column, params: Column, messages: Column, cache_id: Column) -> Column:
    """SHA-256 over compact JSON whose keys are in alphabetical order at every level."""
    payload = F.struct(
        messages.alias("messages"),
        model_id.alias("model_id"),
        sorted_map(model_params).alias("model_params"),
        sorted_map(params).alias("params"),
        cache_id.alias("sample_id"),
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def cache_id(sample_id: Column, middle: Column, task_name: Column) -> Column:
    """``sample:repeat:task`` for tasks, ``sample:step:task`` for workflow steps."""
    return F.concat_ws(":", sample_id, middle.cast("string"), task_name)


def _secret(name: str) -> bool:
    low = name.lower()
    return low in SECRET_NAMES or low.endswith(SECRET_SUFFIXES)


def redact_map(m: Column) -> Column:
    def mask(key: Column, value: Column) -> Column:
        low = F.lower(key)
        hidden = low.isin(*SECRET_NAMES)
        for suffix in SECRET_SUFFIXES:
            hidden = hidden | low.endswith(suffix)
        return F.when(hidden, F.lit(MASK)).otherwise(value)

    return F.transform_values(m, mask)


def redact(c: Column, dtype: T.DataType) -> Column:
    """Mask secret-looking fields of a nested column; the walk is over its type, the work stays in the plan."""
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(MASK) if _secret(f.name) else redact(c.getField(f.name), f.dataType)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda x: redact(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
        return redact_map(c)
    return c
