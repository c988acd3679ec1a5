"""All queries of the engine's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(module) -> None:
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)


def _fill() -> None:
    from citeloom.plans import audit, joins, questions, rounds, scores, summaries, texts

    for module in (texts, scores, joins, rounds, audit, summaries, questions):
        _add(module)


_fill()
