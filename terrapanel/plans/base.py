"""A book of queries: one decorated function and at most one DuckDB statement for each key."""

from __future__ import annotations

import re
import tempfile

from .roles import SQL


def book():
    queries: dict = {}
    oracle: dict = {}

    def query(name: str, sql: str | None = None, roles: str = ""):
        def keep(fn):
            queries[name] = fn
            if sql:
                oracle[name] = with_roles(sql, roles.split())
            return fn

        return keep

    return queries, oracle, query


def with_roles(sql: str, roles: list[str]) -> str:
    """Prefix a statement with the derived tables it reads."""
    if not roles:
        return sql
    return "WITH " + ", ".join(f"{r} AS ({SQL[r]})" for r in roles) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)


def ready(s):
    """The checkpoint folder that the session names; where it names none, a local session gets a temporary one."""
    if not s.sparkContext.getCheckpointDir():
        base = s.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", s.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        s.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-checkpoint-"))
