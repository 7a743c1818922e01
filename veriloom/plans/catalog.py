"""The queries of the core packages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.plans import queries_calibration, queries_corpus, queries_nested, queries_payload, queries_reports, queries_retrieval
from veriloom.plans.registry import ENTRIES, Query

MODULES = (queries_nested, queries_retrieval, queries_calibration, queries_corpus, queries_payload, queries_reports)  # importing them registers their queries


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Recall by transformation and family of exact search over the descriptors."""
    return queries_retrieval.recall_by_stratum(spark, d)


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def operators() -> dict[str, list[str]]:
    """Operator id of the survey to the queries that cover it."""
    out: dict[str, list[str]] = {}
    for name, e in ENTRIES.items():
        for op in e.operators.split():
            out.setdefault(op, []).append(name)
    return out
