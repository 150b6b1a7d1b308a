"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

from lakeweave.llm import (
    component_queries,
    copy_queries,
    frequency_queries,
    lookalike_queries,
    name_queries,
    reading_queries,
    set_queries,
    text_queries,
)

_MODULES = [lookalike_queries, frequency_queries, name_queries, component_queries, set_queries, copy_queries, text_queries, reading_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
