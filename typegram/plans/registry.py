"""Registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from typegram.plans import corpus, grammars, joins, metrics, ngrams, projections, pysources, streams  # noqa: E402, F401
