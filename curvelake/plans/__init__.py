"""Query registries: each operator on the tables of a data folder, and the SQL that states its result."""

from . import analyses, graphs, registry, signals


def all_queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    return dict(registry.SQL)


__all__ = ["all_queries", "all_sql", "analyses", "graphs", "signals"]
