"""Settings of the corpus build, read on the driver: typed, with defaults, bounds and a private part laid over the public one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import RULE

# The operations of cleanup rules, and what each calls the texts that a rule here has as start, end and replacement.
OPERATIONS = {"remove_between": ("start", "end", None), "trim_after": ("marker", None, None), "replace": ("old", None, "new"), "regex_replace": ("pattern", None, "replacement")}


@dataclass(frozen=True)
class CorpusConfig:
    """Sources and sizes of a corpus build; names that are not known are left to other readers."""

    corpus_version: str
    included_sources: tuple[str, ...]
    target_chars: int
    max_chars: int
    min_chars: int
    review_sample_size: int
    random_seed: int
    sentence_overflow_chars: int = 300
    recommendation_context_max_chars: int = 420

    def __post_init__(self):
        wrong = [
            name
            for name, ok in {
                "included_sources": bool(self.included_sources),
                "min_chars <= target_chars <= max_chars": 0 < self.min_chars <= self.target_chars <= self.max_chars,
                "sentence_overflow_chars": self.sentence_overflow_chars >= 0,
                "recommendation_context_max_chars": self.recommendation_context_max_chars >= 120,
            }.items()
            if not ok
        ]
        if wrong:
            raise ValueError(f"settings out of bounds: {wrong}")

    @classmethod
    def from_json(cls, text: str) -> CorpusConfig:
        given = json.loads(text)
        types = {"corpus_version": str, "included_sources": tuple}
        try:
            return cls(**{name: types.get(name, int)(given[name]) for name in cls.__dataclass_fields__ if name in given})
        except TypeError as e:
            raise ValueError(f"settings are missing: {e}") from e


@dataclass
class CleanupConfig:
    """Reviewed repairs of a corpus build: rules and overrides by node."""

    node_cleanup_rules: dict[str, list[dict]] = field(default_factory=dict)
    recommendation_context_overrides: dict[str, str] = field(default_factory=dict)
    display_title_overrides: dict[str, str] = field(default_factory=dict)
    source_tail_stop_markers: dict[str, list[dict]] = field(default_factory=dict)
    content_anchor_node_ids: list[str] = field(default_factory=list)
    high_risk_review_node_ids: list[str] = field(default_factory=list)
    allowed_missing_manual_evidence: list[str] = field(default_factory=list)
    required_recommendation_context_override_ids: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str, private: str | None = None) -> CleanupConfig:
        """The public settings; the private ones' context overrides are laid over them, node by node.

        A required node without an override, or with a blank one, is an error, and so
        is a rule that is no list of known operations.
        """
        given = json.loads(text)
        out = cls(**{name: given[name] for name in cls.__dataclass_fields__ if name in given})
        over = json.loads(private).get("recommendation_context_overrides", {}) if private else {}
        if not isinstance(over, dict) or not isinstance(out.recommendation_context_overrides, dict):
            raise ValueError("recommendation_context_overrides must be an object")
        out.recommendation_context_overrides = out.recommendation_context_overrides | over
        missing = [n for n in out.required_recommendation_context_override_ids if not str(out.recommendation_context_overrides.get(n, "")).strip()]
        if missing:
            raise ValueError(f"required context overrides are missing: {missing}")
        for node, rules in out.node_cleanup_rules.items():
            if not isinstance(rules, list):
                raise ValueError(f"rules must be a list: {node}")
            unknown = [r.get("operation") for r in rules if r.get("operation") not in OPERATIONS]
            if unknown:
                raise ValueError(f"unknown cleanup operations of {node}: {unknown}")
        return out

    def rules(self, spark: SparkSession) -> DataFrame:
        """(node_id, rules) as corpus.clean_bodies takes them; a rule is required unless it says otherwise."""

        def row(node: str, n: int, r: dict) -> dict:
            start, end, to = OPERATIONS[r["operation"]]
            flags = {k: bool(r.get(k, False)) for k in ("keep_start", "keep_end", "include_marker")}
            count = int(r.get("count", -1 if r["operation"] == "replace" else 0))
            return {"operation": r["operation"], "start": str(r[start]), "end": str(r[end]) if end else None, "replacement": str(r[to]) if to else None, "count": count, **flags, "required": bool(r.get("required", True)), "rule_id": str(r.get("rule_id", f"{node}-R{n:02d}"))}

        rows = [(node, [row(node, n, r) for n, r in enumerate(rules, 1)]) for node, rules in self.node_cleanup_rules.items()]
        return spark.createDataFrame(rows, "node_id string, rules " + RULE)

    def overrides(self, spark: SparkSession) -> DataFrame:
        """(node_id, context)"""
        return spark.createDataFrame(list(self.recommendation_context_overrides.items()), "node_id string, context string")
