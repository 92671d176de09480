"""Queries of the inspection operators over the test tables, and their SQL."""

from brindle.plans import catalog, detection, evaluation, layouts, pipelines, rules, traffic  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)
