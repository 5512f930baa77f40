"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import answer_plans, audit_plans, corpus_plans, dataset_plans, name_plans, search_plans

_MODULES = (search_plans, corpus_plans, name_plans, dataset_plans, audit_plans, answer_plans)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
FLAGSHIP = "bm25_topk"
