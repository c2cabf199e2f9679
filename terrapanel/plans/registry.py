"""All registered queries and their DuckDB statements."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

_MODULES: tuple[str, ...] = ("cleaning", "panels", "joins", "estimators", "audits", "evaluation", "sources", "surfaces", "counterfactuals")


def _modules():
    return [importlib.import_module(f"terrapanel.plans.{name}") for name in _MODULES]


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.ORACLE
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["did_label_monthly"](spark, sf_dir)
