"""Settings from a TOML file, overridden by environment variables named GLEANER_<SECTION>_<KEY>."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from typing import Any

#: Defaults by section; a variable's text becomes the type of its default.
DEFAULTS: dict[str, dict[str, Any]] = {
    "chunking": {"max_chars": 2000, "overlap": 200, "min_chars": 50},
    "code_chunking": {"max_chars": 2000, "overlap": 200, "min_chars": 80},
    "retrieval": {"top_k": 10, "score_threshold": 0.45, "dynamic_threshold_ratio": 0.75, "min_relevance_score": 0.5, "min_relevant_chunks": 1, "token_budget": 4000},
    "embedding": {"batch_size": 30, "batch_chars": 48_000},
    "repos": {"paths": [], "exclude_patterns": []},
}


def _typed(text: str, default: Any) -> Any:
    if isinstance(default, bool):
        return text.lower() in ("true", "1", "yes")
    if isinstance(default, list):
        return [part.strip() for part in text.split(",") if part.strip()]
    return type(default)(text)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, dict[str, Any]]:
    """Defaults, then the file's values, then the environment's; sections and keys of the file that have no default stay."""
    given = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    environment = dict(os.environ) if environment is None else environment
    out = {section: {**DEFAULTS.get(section, {}), **given.get(section, {})} for section in {**DEFAULTS, **given}}
    for section, values in out.items():
        for key, value in values.items():
            text = environment.get(f"GLEANER_{section.upper()}_{key.upper()}")
            if text is not None:
                values[key] = _typed(text, value)
    return out


def checked_request(query: str, top_k: int = 10, min_score: float = 0.0) -> tuple[str, int, float]:
    """The bounds of a request: 1 to 10,000 characters that are not all blank, 1 to 50 results, scores from 0 to 1."""
    if not (1 <= len(query) <= 10_000 and query.strip()):
        raise ValueError("a query has 1 to 10,000 characters and is not blank")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k is from 1 to 50")
    if not 0 <= min_score <= 1:
        raise ValueError("min_score is from 0 to 1")
    return query, top_k, min_score
