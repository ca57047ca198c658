"""All registered queries with their SQL twins."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("scalars", "relational", "retrieval", "flows")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"corpusward.catalog.{family}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
