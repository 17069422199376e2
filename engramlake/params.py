"""Parameters of the operators, with the defaults of the documented configuration."""

from __future__ import annotations

import dataclasses
import json
import re


@dataclasses.dataclass(frozen=True)
class Params:
    similarity_threshold: float = 0.6
    embedding_dimensions: int = 768
    max_vectors_per_shard: int = 50_000
    default_link_type: str = "related"
    default_link_strength: float = 0.5
    auto_link_max_connections: int = 3
    auto_link_similarity_threshold: float = 0.5
    dedup_similarity_threshold: float = 0.75
    decay_enabled: bool = True
    initial_stability: float = 1.0
    decay_exponent: float = -0.5
    retrievability_factor: float = 0.9
    growth_factor: float = 0.3
    tag_weight: float = 0.3
    over_fetch: int = 4
    hebbian_delta: float = 0.05
    prune_retrievability_floor: float = 0.05
    prune_min_age_days: float = 7.0
    prune_max_degree: int = 2
    merge_similarity: float = 0.95
    link_strength_floor: float = 0.1
    link_min_age_hours: float = 24.0
    cluster_min_strength: float = 0.5
    cluster_min_size: int = 3
    ephemeral_ttl_days: float = 7.0
    workspace_capacity: int = 5
    synthesis_stability: float = 5.0
    max_synthesised: int = 10
    container_prefix: str = "note"


def _merged(base: dict, over: dict) -> dict:
    """Deep merge: nested keys of base that over does not name stay."""
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def strip_comments(text: str) -> str:
    """JSON with // and /* */ comments and trailing commas as plain JSON; strings, such as URLs, stay whole."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
    return token.sub(lambda m: m[0] if m[0].startswith('"') else "", text)


def load(*texts: str) -> Params:
    """Parameters from JSON texts, later ones over earlier ones; keys may be nested one level and unknown ones are ignored."""
    conf: dict = {}
    for t in texts:
        conf = _merged(conf, json.loads(strip_comments(t)))
    flat = {k: v for k, v in conf.items() if not isinstance(v, dict)}
    for k, v in conf.items():
        if isinstance(v, dict):
            flat.update({f"{k}_{n}": x for n, x in v.items()} | {n: x for n, x in v.items() if n not in flat})
    names = {f.name for f in dataclasses.fields(Params)}
    return Params(**{k: v for k, v in flat.items() if k in names})
