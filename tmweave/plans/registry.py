"""All registered queries of the translation-memory operators, and their SQL."""

from __future__ import annotations

from tmweave.plans import change_queries, corpus_queries, markup_queries, memory_queries, report_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (memory_queries, report_queries, corpus_queries, markup_queries, change_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
