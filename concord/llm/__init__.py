"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from concord.llm import registry

queries, oracle_sql = registry.queries, registry.oracle_sql
