"""All queries of this subpackage, by name."""

from __future__ import annotations

from lucidra.llm import corpus_queries, record_queries

QUERIES = {**record_queries.QUERIES, **corpus_queries.QUERIES}
ORACLES = {**record_queries.ORACLES, **corpus_queries.ORACLES}
