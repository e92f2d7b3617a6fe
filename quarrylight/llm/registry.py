"""Names under which the subpackage's queries are registered."""

from __future__ import annotations

from . import queries as q
from .sql import ORACLE


def queries() -> dict:
    return {k: v for k, v in sorted(vars(q).items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in queries()}
