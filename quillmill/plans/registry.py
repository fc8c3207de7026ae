"""All queries of the library by name."""

from . import more_queries, rule_queries, text_queries  # noqa: F401  the other two add to the same tables

FLAGSHIP = "composite_health"


def queries():
    return dict(text_queries.QUERIES)


def oracle_sql():
    return dict(text_queries.SQL)
