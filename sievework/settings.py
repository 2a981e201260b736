"""Settings: defaults, a YAML (or JSON) file over them, ${VAR} from the environment, checked when they are read."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

# The defaults and, for some, what they may be.
DEFAULTS: dict = {
    "env": "local",
    "rag": {"strategy": "hybrid", "fusion_num_queries": 4, "corrective_grade_min": 0.30, "self_rag_relevance_min": 0.30, "graph_expand_hops": 1, "raptor_levels": 2, "agentic_max_steps": 4},
    "retrieval": {"top_k_dense": 40, "top_k_sparse": 40, "rrf_k": 60, "rerank_top_n": 8, "min_rerank_score": 0.15, "filter_fallback_min_candidates": 5},
    "generation": {"max_context_chunks": 8, "context_budget_tokens": 3500},
    "chunking": {"target_tokens": 384, "overlap": 0.15},
    "guardrails": {"input": {"pii": "block", "injection": "sanitize", "max_query_tokens": 512, "rate_limit_per_min": 30}, "output": {"grounding_min": 0.6, "pii": "redact", "toxicity": "block"}},
    "eval": {"golden_suite": "", "gate_thresholds": {"faithfulness": 0.85, "answer_relevancy": 0.80, "context_recall": 0.75}, "judge_role": "judge"},
    "caching": {"response_ttl_s": 3600, "rewrite_ttl_s": 3600},
    "backends": {"embedding": "hashed"},
    "optimization": {"semantic_cache": True, "semantic_cache_threshold": 0.90, "semantic_cache_max_entries": 2000},
}
CHOICES = {
    "guardrails.input.pii": ("block", "redact", "off"), "guardrails.input.injection": ("sanitize", "block", "off"),
    "guardrails.output.pii": ("redact", "block", "off"), "guardrails.output.toxicity": ("block", "flag", "off"),
}


def expanded(value: object, env: Mapping[str, str]) -> object:
    """${VAR} in all strings; a variable that isn't set stays as it is."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    return [expanded(v, env) for v in value] if isinstance(value, list) else value


def merged(base: dict, over: dict, at: str = "") -> dict:
    """over laid on base; a value of another kind than the default's, or none of its choices, is an error that names its place."""
    out = dict(base)
    for k, v in over.items():
        place = f"{at}{k}"
        known = base.get(k)
        if isinstance(known, dict) and k != "gate_thresholds":
            if not isinstance(v, dict):
                raise ValueError(f"{place} must be a table")
            v = merged(known, v, f"{place}.")
        elif isinstance(known, bool) and not isinstance(v, bool) or isinstance(known, int | float) and not isinstance(known, bool) and not isinstance(v, int | float):
            raise ValueError(f"{place} must be like {known!r}, not {v!r}")
        elif place in CHOICES and v not in CHOICES[place]:
            raise ValueError(f"{place} must be one of {', '.join(CHOICES[place])}, not {v!r}")
        out[k] = v
    return out


def parse(text: str) -> dict:
    """A YAML text, or a JSON one where no YAML reader is installed."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def load(spark: SparkSession | None = None, path: str | None = None, env: Mapping[str, str] = os.environ) -> dict:
    """The defaults with the file's values; the file is read by Spark, so it may lie on any file system."""
    if path is None:
        return merged(DEFAULTS, {})
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file
    return merged(DEFAULTS, expanded(parse(text), env))
