"""All queries of the library, by module."""

from __future__ import annotations

from pledgelens.plans import core, learning, loads, texts

MODULES = [core, loads, texts, learning]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
