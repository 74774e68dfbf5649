"""Queries of all operators over the star schema, each with SQL where SQL can state it."""

from __future__ import annotations


def _load():
    from . import bindings, demand, features, knowledge, lifecycle, models, sources  # noqa: F401

    return bindings


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_load().SQL)
