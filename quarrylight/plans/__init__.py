"""Named queries over the tables, each with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES (name -> f(spark, sf_dir)) and ORACLE (name -> SQL).
MODULES = ("facets", "relational", "aggregates", "texts", "flows", "composites", "files", "operations", "graph")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        for k, v in getattr(import_module(f"{__name__}.{m}"), attr).items():
            if k in out:
                raise ValueError(f"query {k!r} is registered twice")
            out[k] = v
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
