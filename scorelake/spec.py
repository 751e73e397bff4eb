"""Declarative run settings: metric rules, scorer presets, task specs and workflow steps.

These are small driver-side values; everything they describe runs as DataFrame work.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class MetricRule:
    type: str
    name: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        return self.options.get(key, default)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> "MetricRule":
        rest = {k: v for k, v in raw.items() if k not in ("type", "name")}
        return cls(raw["type"], raw.get("name") or None, rest)


@dataclass(frozen=True)
class ScorerPreset:
    answer_type: str
    primary_metric: str
    pass_threshold: float
    metrics: tuple[MetricRule, ...]


@dataclass(frozen=True)
class TaskSpec:
    name: str
    version: str = "v1"
    prompt_version: str = "unknown"
    system: str = ""
    user: str = ""
    optional_sections: tuple[tuple[str, str], ...] = ()
    few_shot: tuple[tuple[str, str], ...] = ()
    serialize_fields: tuple[str, ...] = ()
    field_mapping: dict[str, str] = field(default_factory=dict)
    parse_schema: tuple[dict[str, Any], ...] = ()
    metrics: tuple[MetricRule, ...] = ()
    answer_type: str | None = None
    default_params: dict[str, str] = field(default_factory=dict)

    @property
    def parse_applicable(self) -> bool:
        return bool(self.parse_schema)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> "TaskSpec":
        params = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (raw.get("default_params") or {}).items()}
        return cls(
            name=str(raw["name"]),
            version=str(raw.get("version", "v1")),
            prompt_version=str(raw.get("prompt_version", "unknown")),
            system=raw.get("system", ""),
            user=raw.get("user", ""),
            optional_sections=tuple(map(tuple, raw.get("optional_sections", ()))),
            few_shot=tuple(map(tuple, raw.get("few_shot", ()))),
            serialize_fields=tuple(raw.get("serialize_fields", ())),
            field_mapping=dict(raw.get("field_mapping") or {}),
            parse_schema=tuple(raw.get("parse_schema", ())),
            metrics=tuple(MetricRule.of(m) for m in raw.get("metrics", ())),
            answer_type=raw.get("answer_type"),
            default_params=params,
        )


@dataclass(frozen=True)
class WorkflowStep:
    id: str
    task: str
    model_id: str = "$active"
    input_from: str = "sample"
    params_override: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class WorkflowSpec:
    name: str
    version: str
    steps: tuple[WorkflowStep, ...]


# Scorer presets by answer type.
PRESETS: dict[str, ScorerPreset] = {
    p.answer_type: p
    for p in (
        ScorerPreset("choice", "exact_match", 0.5, (
            MetricRule("exact_match", "choice_acc", {"pred_field": "value", "label_field": "value", "normalize": True}),
        )),
        ScorerPreset("number", "within_tol", 0.5, (
            MetricRule("numeric_error", "value", {"pred_field": "value", "label_field": "value", "tolerance": 0.01}),
        )),
        ScorerPreset("list", "f1", 0.5, (
            MetricRule("list_overlap", "list", {"pred_field": "items", "label_field": "items", "normalize": True}),
        )),
        ScorerPreset("text", "rouge1", 0.3, (
            MetricRule("reference_rouge", None, {"output_field": "value", "reference_field": "gt_value"}),
        )),
        ScorerPreset("reasoning", "final_answer_acc", 0.5, (
            MetricRule("exact_match", "final_answer_acc", {"pred_field": "final_answer", "label_field": "gt_final_answer"}),
            MetricRule("reasoning_consistency", "reasoning", {
                "final_answer_field": "final_answer", "support_fields": ["steps", "claims", "rationale"]}),
            MetricRule("claim_evidence_overlap", "evidence", {
                "claims_field": "claims", "label_field": "gt_evidence_ids", "claim_evidence_key": "evidence"}),
        )),
    )
}

# Fields, ranges and rules of the stock tasks. The prompt wording is our own.
_JSON_ONLY = "Reply with one JSON object and nothing else."
TASKS: dict[str, TaskSpec] = {
    t.name: t
    for t in (
        TaskSpec.from_dict({
            "name": "ie_json", "prompt_version": "ie_json.scorelake1",
            "system": f"Pull the main event out of financial news. {_JSON_ONLY}",
            "user": "Symbol {ticker}. News list: {news_items_json}\n"
                    "Fields wanted: ticker, event_type, sentiment, impact_score (-5 to 5), summary.",
            "serialize_fields": ["news_items"],
            "parse_schema": [
                {"field": "ticker", "type": "str", "default": ""},
                {"field": "event_type", "type": "enum", "default": "other",
                 "values": ["earnings", "policy", "product", "macro", "other"]},
                {"field": "sentiment", "type": "enum", "default": "neutral",
                 "values": ["positive", "neutral", "negative"]},
                {"field": "impact_score", "type": "int", "default": 0, "lo": -5, "hi": 5},
                {"field": "summary", "type": "str", "default": ""},
            ],
            "metrics": [{"type": "field_completeness",
                         "fields": ["ticker", "event_type", "sentiment", "impact_score", "summary"]}],
        }),
        TaskSpec.from_dict({
            "name": "news_dedup", "prompt_version": "news_dedup.scorelake1",
            "system": f"Find news items of one day that say the same thing. {_JSON_ONLY}",
            "user": "Symbol {ticker}. News list: {news_items_json}\nFields wanted: deduped_titles, removed_count.",
            "serialize_fields": ["news_items"],
            "parse_schema": [
                {"field": "deduped_titles", "type": "list", "default": []},
                {"field": "removed_count", "type": "int", "default": 0, "lo": 0, "hi": 1000},
            ],
            "metrics": [{"type": "custom_ratio", "name": "dedup_ratio", "numerator_field": "removed_count",
                         "denominator_sample_field": "news_items"}],
        }),
        TaskSpec.from_dict({
            "name": "stock_score", "prompt_version": "stock_score.scorelake1",
            "system": f"Rate how the news bears on one stock. {_JSON_ONLY}",
            "user": "Symbol {ticker}. News list: {news_items_json}\nFields wanted: score (-100 to 100), rationale.",
            "serialize_fields": ["news_items"],
            "parse_schema": [
                {"field": "score", "type": "int", "default": 0, "lo": -100, "hi": 100},
                {"field": "rationale", "type": "str", "default": ""},
            ],
            "metrics": [
                {"type": "field_completeness", "fields": ["score", "rationale"]},
                {"type": "custom_ratio", "name": "score_abs_normalized", "numerator_field": "score",
                 "denominator_fixed": 100},
            ],
        }),
        TaskSpec.from_dict({
            "name": "news_analysis", "prompt_version": "news_analysis.scorelake1",
            "system": f"Summarise one news story and judge its sentiment. {_JSON_ONLY}",
            "user": "Symbol {ticker} ({sec_short_name}). Title: {news_title}\nBody: {news_body}\n"
                    "Fields wanted: summary, sentiment (positive, neutral or negative).",
            "field_mapping": {"gt_summary": "ref_summary", "gt_sentiment": "label_sentiment"},
            "parse_schema": [
                {"field": "summary", "type": "str", "default": ""},
                {"field": "sentiment", "type": "enum", "default": "neutral",
                 "values": ["positive", "neutral", "negative"]},
            ],
            "metrics": [
                {"type": "field_completeness", "fields": ["summary", "sentiment"]},
                {"type": "reference_rouge", "output_field": "summary", "reference_field": "ref_summary"},
                {"type": "exact_match", "name": "sentiment_acc", "pred_field": "sentiment",
                 "label_field": "label_sentiment"},
            ],
        }),
        TaskSpec.from_dict({
            "name": "stock_association", "prompt_version": "stock_association.scorelake1", "answer_type": "list",
            "system": f"Name the core stocks of a market concept. {_JSON_ONLY}",
            "user": "Concept {plate_name}. About it: {plate_desc}{chains_section}{plate_intro_section}\n"
                    "List about {core_stocks_count} six-digit codes under the key stocks.",
            "optional_sections": [["chains", "\nChain steps: "], ["plate_intro", "\nMore detail: "]],
            "default_params": {"response_format": {"type": "json_object"}},
            "parse_schema": [{"field": "stocks", "type": "list", "max_len": 100}],
            "metrics": [
                {"type": "field_completeness", "fields": ["stocks"]},
                {"type": "list_overlap", "name": "stock_recall", "pred_field": "stocks", "label_field": "gt_stocks"},
            ],
        }),
    )
}


def resolve_rules(
    answer_type: str | None,
    task_rules: tuple[MetricRule, ...],
    presets: dict[str, ScorerPreset] = PRESETS,
) -> tuple[MetricRule, ...]:
    """A task's own rules win; a preset fills in only when the task names an answer type and has no rules."""
    preset = presets.get(answer_type) if answer_type is not None else None
    if preset is None or task_rules:
        return tuple(task_rules)
    return preset.metrics


def load_profile(path: str | Path, known_types: list[str]) -> dict[str, ScorerPreset]:
    """Scorer presets by answer type from a ``.json`` (or, where PyYAML is present, ``.yaml``) profile.

    ``{"scorers": {type: {"primary_metric": .., "pass_threshold": .., "metrics": [..]}}}``; the given metric types must be known.
    """
    scorers = (_load(Path(path)) or {}).get("scorers") or {}
    presets = {
        kind: ScorerPreset(kind, str(raw.get("primary_metric", "")), float(raw.get("pass_threshold", 0.5)), tuple(MetricRule.of(m) for m in raw.get("metrics") or ()))
        for kind, raw in scorers.items()
    }
    unknown = sorted({m.type for p in presets.values() for m in p.metrics} - set(known_types))
    if unknown:
        raise ValueError(f"{path}: unknown metric types {unknown}; known: {sorted(known_types)}")
    return presets


def _load(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise ImportError(f"{path}: reading YAML needs PyYAML; use JSON instead") from exc
    return yaml.safe_load(text)


def discover_tasks(folder: str | Path) -> dict[str, TaskSpec]:
    """Task specs by file name from a folder of ``.json`` (or, where PyYAML is present, ``.yaml``) files."""
    found = {}
    for path in sorted(Path(folder).iterdir()):
        if path.suffix not in (".json", ".yaml", ".yml"):
            continue
        raw = _load(path)
        found[path.stem] = TaskSpec.from_dict(raw)
    return found


def task(name: str, tasks: dict[str, TaskSpec] = TASKS) -> TaskSpec:
    if name not in tasks:
        raise ValueError(f"unknown task {name!r}; known: {sorted(tasks)}")
    return tasks[name]


def parse_step_models(text: str, active: str | None) -> tuple[str, dict[str, str]]:
    """``"m"`` or ``"step1=m1,step2=m2"`` to (default model, step overrides)."""
    if "=" not in (text or ""):
        return (text or "").strip() or (active or ""), {}
    pairs = (part.split("=", 1) for part in text.split(",") if "=" in part)
    return active or "", {step.strip(): model.strip() for step, model in pairs}
