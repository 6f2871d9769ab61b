"""Queries over the given tables, and the same in SQL."""


def _modules():
    from . import cards, claims, decisions, pages, retrieval, spans

    return (retrieval, spans, decisions, pages, claims, cards)


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
