"""Whole runs as one lazy plan: a task over samples x models x repeats, and a workflow over samples.

Calls are recorded data. A task run expands the grid, drops finished work, builds requests, takes cached
answers, joins recorded calls, parses, scores, prices and types errors. Each plan touches every input once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.errors import UNKNOWN, append_error, derive_error
from scorelake.functions.keys import cache_id, cache_key, call_cost
from scorelake.functions.outputs import apply_schema, parse_outputs
from scorelake.operators import grid as G
from scorelake.operators.metrics import scoring_error, task_metrics
from scorelake.operators.projections import build_requests, called_rows, map_fields, map_literal, utc_now_text
from scorelake.operators.workflow import gate
from scorelake.schemas import METRIC_LIST, RESULT_ROW, RESULT_SCHEMA_VERSION, STEP_E2E, STEP_TASK, as_struct
from scorelake.spec import TASKS, TaskSpec, WorkflowSpec, WorkflowStep, resolve_rules

CALL_COLUMNS = [
    "content", "prompt_tokens", "completion_tokens", "latency_ms", "success", "error", "retry_count",
    "error_type", "error_stage", "error_code",
]
NO_ANSWER = ("gateway_error: no recorded answer", "gateway_failure", "gateway", "gateway_error")


def call_values(column, missing: Column) -> dict[str, Column]:
    """Call columns with their defaults; a missing call becomes a failed one with a gateway error."""
    text, kind, stage, code = NO_ANSWER
    blank = lambda c: F.coalesce(column(c), F.lit(""))
    return {
        "content": blank("content"),
        **{c: F.coalesce(column(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "retry_count")},
        "latency_ms": F.coalesce(column("latency_ms"), F.lit(0.0)),
        "success": F.coalesce(column("success"), F.lit(False)),
        "error": F.when(missing, text).otherwise(blank("error")),
        "error_type": F.when(missing, kind).otherwise(blank("error_type")),
        "error_stage": F.when(missing, stage).otherwise(blank("error_stage")),
        "error_code": F.when(missing, code).otherwise(blank("error_code")),
    }


def score_calls(calls: DataFrame, task: TaskSpec, sample: str = "sample", skip: str | None = None) -> DataFrame:
    """Parse and score answered calls that carry their sample as a struct.

    Reads ``content``, ``success`` and ``error``; adds ``parsed_json``, ``parse_success`` and ``task_metrics``. Metrics run
    on failed calls too, with nothing parsed; rows with the ``skip`` flag have none. A row whose metrics cannot be
    computed is no success, has no metrics, and its error text says why.
    """
    if task.parse_schema:
        rows = calls.withColumn("_answer", F.when(F.col("success"), F.col("content")))
        rows = parse_outputs(rows, "_answer", "_parse")
        rows = rows.withColumn("parsed", apply_schema(F.col("_parse.data"), task.parse_schema)).drop("_answer", "_parse")
    else:
        rows = calls.withColumn("parsed", F.lit(None).cast("struct<none:string>"))
    rules = resolve_rules(task.answer_type, task.metrics)
    scores, broken = task_metrics(rows.schema, rules, "parsed", sample), scoring_error(rows.schema, rules, "parsed", sample)
    if skip:
        scores = F.when(F.col(skip), F.array().cast(METRIC_LIST)).otherwise(scores)
        broken = F.when(~F.col(skip), broken)
    return rows.withColumns({
        "success": F.col("success") & broken.isNull(),
        "error": F.when(broken.isNotNull(), append_error(F.col("error"), broken)).otherwise(F.col("error")),
        "parse_success": F.col("parsed").isNotNull(),
        "parsed_json": F.to_json("parsed", {"ignoreNullFields": "false"}),
        "task_metrics": F.when(broken.isNotNull(), F.array().cast(METRIC_LIST)).otherwise(scores),
    }).drop("parsed")


def pending_requests(
    samples: DataFrame, models: DataFrame, task: TaskSpec, model_ids: list[str], repeats: int = 1,
    params: dict[str, str] | None = None, done: DataFrame | None = None, with_cache_key: bool = True,
) -> DataFrame:
    """Grid minus finished work, with messages, merged parameters and, for a cached run, the cache key."""
    work = G.work_grid(samples, task.name, model_ids, repeats)
    if done is not None:
        work = G.pending_work(work, done)
    requests = build_requests(work, task).withColumn("params", map_literal({**task.default_params, **(params or {})}))
    if not with_cache_key:
        return G.with_price(requests, models)
    priced = G.with_price(requests, models, "default_params")
    key = cache_key(
        F.col("model_id"), F.col("default_params"), F.col("params"), F.col("messages"),
        cache_id(F.col("sample_id"), F.col("repeat_idx"), F.col("task_name")),
    )
    return priced.withColumn("cache_key", key).drop("default_params")


def task_run(
    samples: DataFrame, models: DataFrame, calls: DataFrame, task: TaskSpec, model_ids: list[str], repeats: int = 1,
    run_id: str = "run", params: dict[str, str] | None = None, done: DataFrame | None = None,
    cache: DataFrame | None = None,
) -> DataFrame:
    """Result rows of one task run.

    ``calls`` are recorded answers by (sample_id, model_id, repeat_idx), of several the newest (``timestamp``, where they have it). Work with neither a cached nor a
    recorded answer becomes a gateway error row, so every piece of pending work has exactly one row.
    """
    names = samples.columns
    requests = pending_requests(samples, models, task, model_ids, repeats, params, done, with_cache_key=cache is not None)
    keys = ["sample_id", "model_id", "repeat_idx"]
    mapped = map_fields(requests, task.field_mapping)
    extra = [c for c in task.field_mapping.values() if c in mapped.columns and c not in names]
    base = mapped.withColumn("sample", F.struct(*names, *extra)).select(
        *keys, "task_name", "prompt_version", "params", "price", "sample", *(["cache_key"] if cache is not None else [])
    )
    stamp = [c for c in ("timestamp",) if c in calls.columns]
    recorded = G.newest_per_key(calls.select(*keys, *CALL_COLUMNS, *stamp), keys, stamp).select(*keys, F.struct(*CALL_COLUMNS).alias("_call"))
    if cache is None:
        joined = base.withColumns({"from_cache": F.lit(False), "_hit": F.lit(None).cast(recorded.schema["_call"].dataType)})
    else:
        hits = G.cache_lookup(base, cache.select("cache_key", *CALL_COLUMNS, *[c for c in ("written_at",) if c in cache.columns]))
        joined = hits.withColumn("_hit", F.when(F.col("from_cache"), F.struct(*CALL_COLUMNS))).drop(*CALL_COLUMNS)
    joined = joined.join(recorded, keys, "left").withColumn("_call", F.coalesce("_hit", "_call")).drop("_hit")
    missing = F.col("_call").isNull()
    filled = joined.withColumns({
        **call_values(lambda c: F.col(f"_call.{c}"), missing), "_missing": missing,
        "parse_applicable": F.lit(task.parse_applicable),
    }).drop("_call")
    scored = score_calls(filled, task, skip="_missing")
    return called_rows(scored, {
        "run_id": F.lit(run_id), "mode": F.lit("task"), "task_version": F.lit(task.version), "step_id": F.lit(STEP_TASK),
    })


# --- workflow --------------------------------------------------------------------------------------------

def _result_struct(values: dict[str, Column]) -> Column:
    """A struct in the result schema; fields not given take a blank, zero or null."""
    blanks = {"string": F.lit(""), "double": F.lit(0.0), "int": F.lit(0), "boolean": F.lit(False)}
    out = []
    for field in as_struct(RESULT_ROW).fields:
        kind = field.dataType.simpleString()
        value = values[field.name] if field.name in values else blanks.get(kind, F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*out)


def _step_calls(calls: DataFrame, spec: WorkflowSpec, tasks: dict[str, TaskSpec]) -> DataFrame:
    """Recorded calls of all steps side by side, one row per sample: one shuffle for any number of steps.

    Answers are parsed while they are still one row per call, by one parser for all steps. Of several calls of a step the
    newest counts (``timestamp``, where they have it).
    """
    listed = G.newest_per_key(calls.where(F.col("step_id").isin(*[s.id for s in spec.steps])), ["sample_id", "step_id"], ["timestamp"])
    parsed = [s.id for s in spec.steps if tasks[s.task].parse_applicable]
    to_parse = F.col("step_id").isin(*parsed) & F.col("success") if parsed else F.lit(False)
    rows = parse_outputs(listed.withColumn("_answer", F.when(to_parse, F.col("content"))), "_answer", "_parse")
    call = F.struct(*CALL_COLUMNS, "from_cache", F.col("_parse.data").alias("data"))
    return rows.groupBy("sample_id").agg(*[
        F.any_value(F.when(F.col("step_id") == s.id, call), True).alias(f"_call{i}") for i, s in enumerate(spec.steps)
    ])


def workflow_run(
    samples: DataFrame, models: DataFrame, calls: DataFrame, spec: WorkflowSpec, step_models: dict[str, str],
    tasks: dict[str, TaskSpec] = TASKS, run_id: str = "run", params: dict[str, str] | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """Step rows and end-to-end rows of a workflow over all samples.

    ``calls`` are recorded answers by (sample_id, step_id); ``step_models`` gives every step its model. A
    sample and the calls of its few listed steps meet in one row; parsing, gating, scoring and the roll-up
    are columns of that row, which is then unfolded into its result rows. The loop is over the listed steps.
    """
    if done is not None:
        samples = G.unfinished_workflow_samples(samples, done, spec.name)
    names = samples.columns
    rows = samples.join(_step_calls(calls, spec, tasks), "sample_id", "left").withColumn("sample", F.struct(*names))
    # The few prices come in once, as a column of their own.
    rows = rows.withColumn("_prices", _prices(models, step_models, spec))
    rows = rows.select("sample_id", "sample", "_prices", *[f"_call{i}" for i in range(len(spec.steps))])
    values: dict[str, Column] = {}
    sides: dict[int, str] = {}
    for i, step in enumerate(spec.steps):
        task, p, missing = tasks[step.task], f"s{i}_", F.col(f"_call{i}").isNull()
        values[f"{p}missing"] = missing
        values |= {p + c: v for c, v in call_values(lambda c, i=i: F.col(f"_call{i}.{c}"), missing).items()}
        values[f"{p}from_cache"] = F.coalesce(F.col(f"_call{i}.from_cache"), F.lit(False))
        values[f"{p}parsed"] = (
            apply_schema(F.col(f"_call{i}.data"), task.parse_schema) if task.parse_schema else F.lit(None).cast("struct<none:string>")
        )
        mapped = {src: dst for src, dst in task.field_mapping.items() if src in names}
        sides[i] = f"{p}sample" if mapped else "sample"
        if mapped:
            values[sides[i]] = F.struct("sample.*", *[F.col(f"sample.{src}").alias(dst) for src, dst in mapped.items()])
    rows = rows.select("sample_id", "sample", "_prices", *[v.alias(k) for k, v in values.items()])
    scores: dict[str, Column] = {}
    for i, step in enumerate(spec.steps):
        task, p = tasks[step.task], f"s{i}_"
        metrics = task_metrics(rows.schema, resolve_rules(task.answer_type, task.metrics), f"{p}parsed", sides[i])
        scores |= {
            f"{p}parse_success": F.col(f"{p}parsed").isNotNull(),
            f"{p}parsed_json": F.to_json(f"{p}parsed", {"ignoreNullFields": "false"}),
            f"{p}task_metrics": F.when(F.col(f"{p}missing"), F.array().cast(METRIC_LIST)).otherwise(metrics),
        }
    rows = rows.withColumns(scores)

    good = {
        s.id: ~F.col(f"s{i}_missing") & F.col(f"s{i}_success") & (F.col(f"s{i}_parse_success") if tasks[s.task].parse_applicable else F.lit(True))
        for i, s in enumerate(spec.steps)
    }
    runs = gate(good, {s.id: s.input_from for s in spec.steps})
    rows = rows.withColumns({
        **{f"s{i}_runs": runs[s.id] for i, s in enumerate(spec.steps)},
        **{f"s{i}_price": F.col("_prices")[step_models[s.id]] for i, s in enumerate(spec.steps)},
    })
    common = {"schema_version": F.lit(RESULT_SCHEMA_VERSION), "run_id": F.lit(run_id), "timestamp": utc_now_text(), "sample_id": F.col("sample_id"),
              "workflow_name": F.lit(spec.name), "workflow_version": F.lit(spec.version)}
    built = [_step_struct(i, s, spec, tasks[s.task], step_models[s.id], params or {}, common) for i, s in enumerate(spec.steps)]
    whole = _e2e_struct(spec, step_models, tasks, params or {}, common)
    return rows.select(F.explode(F.array(*built, whole)).alias("r")).select("r.*")


def _prices(models: DataFrame, step_models: dict[str, str], spec: WorkflowSpec) -> Column:
    """Price structs by used model, from one scalar subquery; a model that the registry lacks, or has twice, fails the job."""
    used = sorted({step_models[s.id] for s in spec.steps})
    known = models.where(F.col("model_id").isin(*used))
    prices = known.agg(F.map_from_entries(F.collect_list(F.struct("model_id", "price_config"))).alias("p")).scalar()
    missing = F.array_except(F.array(*[F.lit(m) for m in used]), F.map_keys(prices))
    fail = F.raise_error(F.concat(F.lit("unknown model "), F.array_join(missing, ", ")))
    kind = f"map<string,{models.schema['price_config'].dataType.simpleString()}>"
    return F.when(F.size(missing) == 0, prices).otherwise(fail.cast(kind))


def _step_struct(i: int, step: WorkflowStep, spec: WorkflowSpec, task: TaskSpec, model_id: str, params: dict[str, str], common: dict[str, Column]) -> Column:
    p = f"s{i}_"
    col = lambda c: F.col(p + c)
    named = {
        **common, "mode": F.lit("workflow_step"), "task_name": F.lit(task.name), "step_id": F.lit(step.id), "model_id": F.lit(model_id),
        "params": map_literal({**task.default_params, **params, **step.params_override}),
        "parse_applicable": F.lit(task.parse_applicable), "task_metrics": F.array().cast(METRIC_LIST),
    }
    state = "parse_failed" if step.input_from in [s.id for s in spec.steps[:i]] else "missing"
    code = f"upstream_{state}"
    text = F.lit(f"{code}: upstream_{step.input_from}_{state}")
    skipped = _result_struct({
        **named, "task_version": F.lit("skipped"), "prompt_version": F.lit("skipped"), "error": text, "error_detail": text,
        "error_type": F.lit(code), "error_stage": F.lit("upstream"), "error_code": F.lit(code),
    })
    typed = derive_error(col("success"), F.lit(task.parse_applicable), col("parse_success"), col("error"), col("error_type"), col("error_stage"), col("error_code"))
    ran = _result_struct({
        **named, "task_version": F.lit(task.version), "prompt_version": F.lit(task.prompt_version),
        **{c: col(c) for c in ("success", "error", "parse_success", "prompt_tokens", "completion_tokens", "retry_count", "from_cache", "task_metrics")},
        **{c: typed[c] for c in ("error_type", "error_stage", "error_code", "error_detail")},
        "latency_ms": F.round(col("latency_ms"), 2), "total_tokens": col("prompt_tokens") + col("completion_tokens"),
        "cost_estimate": _step_cost(i), "output_text": col("content"), "parsed": col("parsed_json"),
    })
    return F.when(col("runs"), ran).otherwise(skipped)


def _step_cost(i: int) -> Column:
    return call_cost(*[F.col(f"s{i}_{c}") for c in ("prompt_tokens", "completion_tokens", "price", "from_cache")])


def _e2e_struct(spec: WorkflowSpec, step_models: dict[str, str], tasks: dict[str, TaskSpec], params: dict[str, str], common: dict[str, Column]) -> Column:
    """Roll-up over the step columns; the rules are those of operators.workflow.end_to_end."""
    n = len(spec.steps)
    executed = [F.col(f"s{i}_runs") & ~F.col(f"s{i}_missing") for i in range(n)]
    needs = [tasks[s.task].parse_applicable for s in spec.steps]
    ok = reduce(lambda a, b: a & b, [
        executed[i] & F.col(f"s{i}_success") & (F.col(f"s{i}_parse_success") if needs[i] else F.lit(True)) for i in range(n)
    ])
    total = lambda c: reduce(lambda a, b: a + b, [F.when(executed[i], c(i)).otherwise(F.lit(0)) for i in range(n)])
    applicable = reduce(lambda later, i: F.when(executed[i], F.lit(needs[i])).otherwise(later), range(n), F.lit(True))
    output = F.when(executed[-1], F.col(f"s{n - 1}_parsed_json"))
    parsed_ok = applicable & output.isNotNull()
    text = F.when(ok, "").otherwise("workflow_step_failed")
    # The one message a failed roll-up can have is of unknown type.
    kind, stage, code = UNKNOWN
    failed = lambda word: F.when(ok, "").otherwise(word)
    return _result_struct({
        **common, "mode": F.lit("workflow_e2e"), "task_name": F.lit(spec.name), "task_version": F.lit(spec.version), "step_id": F.lit(STEP_E2E),
        "prompt_version": F.lit("workflow"), "model_id": F.lit("+".join(step_models[s.id] for s in spec.steps)), "params": map_literal(params),
        "success": ok, "error": text, "error_detail": text, "error_type": failed(kind), "error_stage": failed(stage), "error_code": failed(code),
        "parse_applicable": applicable, "parse_success": parsed_ok,
        "latency_ms": F.round(total(lambda i: F.col(f"s{i}_latency_ms")), 2),
        "total_tokens": total(lambda i: F.col(f"s{i}_prompt_tokens") + F.col(f"s{i}_completion_tokens")),
        "retry_count": total(lambda i: F.col(f"s{i}_retry_count")), "cost_estimate": F.round(total(_step_cost), 8),
        "parsed": output, "task_metrics": F.array().cast(METRIC_LIST),
    })


def workflow_requests(
    samples: DataFrame, models: DataFrame, steps_done: DataFrame, spec: WorkflowSpec, step_models: dict[str, str],
    tasks: dict[str, TaskSpec] = TASKS, params: dict[str, str] | None = None, cache: DataFrame | None = None,
) -> DataFrame:
    """The calls that a workflow can make next: (sample_id, step_id, model_id, messages, params, cache_key, from_cache, cached content).

    ``steps_done`` has finished step rows (result rows with ``sample_id``, ``step_id``, ``success``, ``parse_applicable``,
    ``parse_success``, ``parsed``, ``output_text``). A step can be called when it is not finished and reads the sample, or reads a
    step listed before it that ended well; it gets that step's parsed object, or its text where nothing is parsed. The loop is
    over the listed steps; finished steps are brought into one row per sample by one shuffle.
    """
    state = F.struct("success", "parse_applicable", "parse_success", "parsed", "output_text")
    finished = G.newest_per_key(steps_done.where(F.col("step_id").isin(*[s.id for s in spec.steps])), ["sample_id", "step_id"], ["timestamp"])
    by_step = finished.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step_id").alias("k"), state.alias("v")))).alias("_steps"))
    rows = samples.join(by_step, "sample_id", "left")
    parts = []
    for i, step in enumerate(spec.steps):
        task = tasks[step.task]
        up = F.try_element_at("_steps", F.lit(step.input_from))
        if step.input_from == "sample":
            open_now, given = F.lit(True), F.lit(None).cast("string")
        elif step.input_from in [s.id for s in spec.steps[:i]]:
            open_now = F.coalesce(up["success"] & (~up["parse_applicable"] | up["parse_success"]), F.lit(False))
            given = F.when(up["parse_applicable"], up["parsed"]).otherwise(up["output_text"])
        else:
            continue
        due = rows.where(open_now & F.try_element_at("_steps", F.lit(step.id)).isNull()).withColumn("step_input", given)
        asked = build_requests(due.withColumn("task_name", F.lit(task.name)), task, step_input="step_input")
        merged = map_literal({**task.default_params, **(params or {}), **step.params_override})
        parts.append(asked.select("sample_id", F.lit(step.id).alias("step_id"), F.lit(step_models[step.id]).alias("model_id"), "task_name", "messages", merged.alias("params")))
    calls = reduce(DataFrame.unionByName, parts)
    priced = G.with_price(calls, models, "default_params")
    key = cache_key(F.col("model_id"), F.col("default_params"), F.col("params"), F.col("messages"), F.concat_ws(":", "sample_id", F.lit(spec.name), "step_id"))
    keyed = priced.withColumn("cache_key", key).drop("default_params", "price")
    if cache is None:
        return keyed.withColumns({"from_cache": F.lit(False), "content": F.lit(None).cast("string")})
    return G.cache_lookup(keyed, cache.select("cache_key", "content", *[c for c in ("written_at",) if c in cache.columns]))


# --- run registry ----------------------------------------------------------------------------------------

def run_registry_row(run_id: str, config: dict[str, str], fingerprint: DataFrame) -> DataFrame:
    """One row per run: its settings and the fingerprint of its input."""
    return fingerprint.select(F.lit(run_id).alias("run_id"), map_literal(config).alias("config"), "dataset_rows", "dataset_sha256")


def snapshot_rows(run_id: str, snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("run_id", F.lit(run_id))


__all__ = ["task_run", "workflow_run", "workflow_requests", "pending_requests", "score_calls", "run_registry_row", "snapshot_rows"]
