"""The registered queries of the evidence operators and their SQL."""

from strandlog.plans import evidence, graphs, provenance, registry, relational, statistics, streams  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
