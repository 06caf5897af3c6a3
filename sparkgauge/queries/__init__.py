"""All registered queries of the library."""

from sparkgauge.queries import aggregates, extra, generated, graphs, relations, scalars
from sparkgauge.queries.aggregates import flagship
from sparkgauge.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


__all__ = ["aggregates", "extra", "flagship", "generated", "graphs", "oracle_sql", "queries", "relations", "scalars"]
