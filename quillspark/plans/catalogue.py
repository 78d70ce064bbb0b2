"""Registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from . import lexical, ranking

GROUPS = (lexical, ranking)


def queries() -> dict:
    return {f.__name__: f for group in GROUPS for f in group.FOUND}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
