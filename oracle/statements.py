"""One DuckDB statement per registered query."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

from oracle import (  # noqa: E402,F401
    contexts, duplicates, evaluation_sets, operations, replay, retrieval, scoring, selection, text_and_guard)
