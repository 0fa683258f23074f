"""The queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = ("op1_mix", "op2_tokens", "op3_bm25", "op4_html", "op5_lines", "op6_jaccard", "op7_warc", "op8_pack", "op9_quality", "op10_embed", "op11_resample", "op12_repair", "op13_repeats")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"concord.llm.{name}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from concord.llm import oracle

    return dict(oracle.SQL)
