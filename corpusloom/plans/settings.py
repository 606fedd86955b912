"""Settings by environment variables or a file of them, each within its bounds."""

from __future__ import annotations

from collections.abc import Mapping

# What can be set, its default, and its least and greatest value.
BOUNDS: dict[str, tuple[float, float, float]] = {
    "EMBEDDING_DIM": (512, 64, 8192),
    "CHUNK_SIZE": (600, 120, 4000),
    "CHUNK_OVERLAP": (80, 0, 1000),
    "MIN_CHUNK_CHARS": (40, 1, 1000),
    "MAX_CHUNK_CHARS": (1600, 200, 8000),
    "RETRIEVAL_TOP_K": (6, 1, 50),
    "RETRIEVAL_CANDIDATE_K": (30, 2, 200),
    "SEMANTIC_WEIGHT": (0.6, 0.0, 1.0),
    "KEYWORD_WEIGHT": (0.4, 0.0, 1.0),
    "MIN_RELEVANCE_SCORE": (0.18, 0.0, 1.0),
    "MMR_LAMBDA": (0.7, 0.0, 1.0),
    "RERANK_TOP_N": (20, 1, 200),
    "RERANK_WEIGHT": (0.4, 0.0, 1.0),
    "CHUNK_DEDUP_THRESHOLD": (0.96, 0.5, 1.0),
    "DOC_DEDUP_DISTANCE": (3, 0, 32),
    "DOC_DEDUP_LENGTH_TOLERANCE": (0.02, 0.0, 1.0),
    "AGENT_MAX_SUB_QUESTIONS": (4, 1, 10),
    "REFLECTION_MIN_GROUNDED": (0.8, 0.0, 1.0),
    "REFLECTION_MIN_COVERAGE": (0.6, 0.0, 1.0),
    "REFLECTION_MAX_QUERIES": (3, 1, 6),
    "SHORT_TERM_TURNS": (6, 1, 50),
    "SUMMARY_TRIGGER_MESSAGES": (12, 4, 200),
    "LONG_TERM_MAX_ITEMS": (60, 5, 1000),
    "LONG_TERM_MERGE_THRESHOLD": (0.9, 0.5, 1.0),
}


def of_file(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines, # comments and lines without = don't count. Quotes around a value go, and so does what
    follows a blank and a # after a value without quotes. The first of several values counts."""
    found: dict[str, str] = {}
    for line in map(str.strip, text.removeprefix("﻿").splitlines()):
        key, is_, value = line.partition("=")
        if not is_ or line.startswith("#"):
            continue
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        found.setdefault(key.strip(), value[1:-1] if quoted else value.split(" #", 1)[0].strip())
    return found


def settings(*sources: Mapping[str, str]) -> dict[str, float]:
    """Every setting from the first source that has it: a number within its bounds, the default for blanks and what is no number.

    A setting whose default is whole takes whole numbers only.
    """
    out = {}
    for key, (default, low, high) in BOUNDS.items():
        given = next((s[key].strip() for s in sources if s.get(key, "").strip()), None)
        try:
            value = default if given is None else type(default)(given)
        except ValueError:
            value = default
        out[key] = min(max(value, low), high)
    return out
