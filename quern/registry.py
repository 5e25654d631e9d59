"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from quern import queries_aggs, queries_other, queries_search

QUERIES: dict = queries_search.QUERIES | queries_aggs.QUERIES | queries_other.QUERIES
SQL: dict = queries_search.SQL | queries_aggs.SQL | queries_other.SQL
