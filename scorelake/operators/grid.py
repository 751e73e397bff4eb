"""Work grid, resume, cache and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.schemas import RESUME_KEYS, STEP_E2E, STEP_TASK, as_struct


def work_grid(samples: DataFrame, task_name: str, model_ids: list[str], repeats: int) -> DataFrame:
    """Every sample with every model and repeat.

    Models and repeats are run settings, so the grid is generated per sample from two literal arrays; no
    join is involved and the samples keep their partitioning.
    """
    if not model_ids:
        raise ValueError("no model ids given")
    return (
        samples.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in model_ids])))
        .withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(max(1, int(repeats)) - 1))))
        .withColumns({"task_name": F.lit(task_name), "step_id": F.lit(STEP_TASK)})
    )


def completed_keys(results: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Distinct finished keys; a bad or missing repeat counts as 0. Failed rows count as done unless retried."""
    rows = results.where("success") if retry_failed else results
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in RESUME_KEYS[:-1]]
    repeat = F.coalesce(F.col("repeat_idx").cast("string").try_cast("int"), F.lit(0)).alias("repeat_idx")
    return rows.select(*texts, repeat).distinct()


def pending_work(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.select(*RESUME_KEYS), RESUME_KEYS, "left_anti")


def unfinished_samples(samples: DataFrame, done: DataFrame, task_name: str, model_ids: list[str], repeats: int) -> DataFrame:
    """Samples with at least one (model, repeat) left: finished pairs are counted per sample and compared."""
    wanted = len(set(model_ids)) * max(1, int(repeats))
    finished = (
        done.where(
            (F.col("task_name") == task_name) & (F.col("step_id") == STEP_TASK)
            & F.col("model_id").isin(*model_ids) & F.col("repeat_idx").between(0, max(1, int(repeats)) - 1)
        )
        .select(*RESUME_KEYS).distinct()
        .groupBy("sample_id").agg(F.count("*").alias("_done"))
        .where(F.col("_done") >= wanted)
    )
    return samples.join(finished, "sample_id", "left_anti")


def unfinished_workflow_samples(samples: DataFrame, done: DataFrame, workflow: str) -> DataFrame:
    ended = done.where((F.col("task_name") == workflow) & (F.col("step_id") == STEP_E2E)).select("sample_id").distinct()
    return samples.join(ended, "sample_id", "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on ``cache_key``; an entry without content is bad and counts as a miss.

    Of several entries of a key the one written last counts (``written_at``, where the cache has it), then the one whose
    text has the larger digest. Adds the cached call columns and ``from_cache``; pending rows are those with it false.
    """
    entries = newest_per_key(cache.where(F.col("content").isNotNull()), ["cache_key"], ["written_at"])
    hit = entries.withColumn("_hit", F.lit(True)).drop("from_cache", "written_at")
    return requests.join(hit, "cache_key", "left").withColumn("from_cache", F.coalesce("_hit", F.lit(False))).drop("_hit")


def newest_per_key(df: DataFrame, keys: list[str], newest_first: list[str]) -> DataFrame:
    """One row per key: the newest by those of ``newest_first`` that the table has, then by a digest of all columns.

    The digest makes the order full, so the pick never depends on the order of rows. Spark cuts the ranked window
    to one row a key within each task before it shuffles.
    """
    stated = [F.desc_nulls_last(c) for c in newest_first if c in df.columns]
    digest = F.desc(F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*stated, digest))
    return df.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


def new_cache_entries(calls: DataFrame, cache: DataFrame | None, keys: list[str] | None = None) -> DataFrame:
    """Successful calls whose key is not stored yet, one per key (the newest, see :func:`newest_per_key`)."""
    keys = keys or ["cache_key"]
    fresh = newest_per_key(calls.where("success"), keys, ["written_at"])
    return fresh if cache is None else fresh.join(cache.select(*keys), keys, "left_anti")


def with_price(rows: DataFrame, models: DataFrame, *extra: str) -> DataFrame:
    """Add the ``price`` struct of each row's model, and ``extra`` registry columns; a model that the registry does not know, or
    knows twice, fails the job. How the small registry is joined is left to its measured size."""
    entry = F.struct(F.col("price_config").alias("price"), *extra)
    dim = models.groupBy("model_id").agg(F.first(entry).alias("_m"), F.count(F.lit(1)).alias("_known"))
    joined = rows.join(dim, "model_id", "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce("model_id", F.lit("?")))).cast("string")
    checked = F.when(F.col("_known") == 1, F.col("model_id")).when(F.col("_known") > 1, fail("several entries of model ")).otherwise(fail("unknown model "))
    return joined.withColumn("model_id", checked).select(*rows.columns, "_m.*")


def join_truth(rows: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Join predictions to their labels; a prediction without a label fails the job."""
    joined = rows.join(truth.withColumn("_has_truth", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no label for sample "), F.col(key).cast("string"))).cast("string")
    guard = F.when(F.col("_has_truth"), F.col(key).cast("string")).otherwise(missing)
    return joined.withColumn(key, guard.cast(rows.schema[key].dataType)).drop("_has_truth")


def resolve_upstream(steps: DataFrame) -> DataFrame:
    """Join every step to the step it reads from, in the same sample and earlier in order.

    Adds ``upstream_state`` (sample, ok, missing, parse_failed), ``upstream_error`` and ``step_input``: the
    upstream object, or its raw text when that step needs no parsing.
    """
    up = steps.select(
        "sample_id",
        F.col("step_id").alias("input_from"),
        F.col("ord").alias("_uord"),
        F.struct("success", "parse_applicable", "parse_success", "parsed", "raw").alias("_u"),
    )
    joined = steps.alias("s").join(
        up.alias("u"),
        (F.col("s.sample_id") == F.col("u.sample_id")) & (F.col("s.input_from") == F.col("u.input_from"))
        & (F.col("u._uord") < F.col("s.ord")),
        "left",
    ).select("s.*", "u._u")
    failed = ~F.col("_u.success") | (F.col("_u.parse_applicable") & ~F.col("_u.parse_success"))
    state = (
        F.when(F.col("input_from") == "sample", "sample")
        .when(F.col("_u").isNull(), "missing").when(failed, "parse_failed").otherwise("ok")
    )
    value = F.when(F.col("_u.parse_applicable"), F.col("_u.parsed")).otherwise(F.col("_u.raw"))
    out = joined.withColumn("upstream_state", state)
    broken = F.col("upstream_state").isin("missing", "parse_failed")
    return out.withColumns({
        "upstream_error": F.when(broken, F.concat(F.lit("upstream_"), "input_from", F.lit("_"), "upstream_state")),
        "step_input": F.when(F.col("upstream_state") == "ok", value),
    }).drop("_u")


def newest_rows(results: DataFrame) -> DataFrame:
    """One row per result key, the newest; repeats left by a resumed run drop out, ties by a digest of the row."""
    return newest_per_key(results, RESUME_KEYS, ["timestamp"])


def name_join(df: DataFrame, plates: DataFrame, columns: list[str], key: str = "plate_id") -> DataFrame:
    """Left join plate attributes by id; whether the plates are small enough to broadcast is left to the run time."""
    return df.join(plates.select(F.col("id").alias(key), *columns), key, "left")


def ids_to_load(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def literal_rows(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """A few driver-side rows as a table made inside the plan; no Python data is shipped."""
    names = as_struct(ddl).fieldNames()
    structs = [F.struct(*[_literal(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    schema = f"array<{as_struct(ddl).simpleString()}>"
    items = F.array(*structs) if structs else F.array()
    return spark.range(1).select(F.inline(items.cast(schema)))


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.map_from_arrays(F.lit(list(value)).cast("array<string>"), F.lit(list(value.values())).cast("array<string>"))
    if isinstance(value, tuple):
        return F.struct(*[F.lit(v) for v in value])
    return F.lit(value).cast("array<string>") if value == [] else F.lit(value)


def literal_models(spark, rows: list[tuple]) -> DataFrame:
    """Models dimension from (model_id, provider, default_params, (in, out) or None)."""
    return literal_rows(spark, rows, "model_id string, provider string, default_params map<string,string>, "
                        "price_config struct<input_per_1k:double,output_per_1k:double>")


def flag_unknown_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    return rows.join(models.select("model_id"), "model_id", "left_anti")


def cache_bucket(key: Column) -> Column:
    """Two-level prefix of a key, used to partition a stored cache."""
    return F.substring(key, 1, 2)
