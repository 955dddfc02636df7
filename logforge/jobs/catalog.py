"""All registered queries of the library's own operators."""

from __future__ import annotations

from logforge.jobs import learn_queries, measure_queries, prepare_queries


def queries() -> dict:
    return {**prepare_queries.QUERIES, **measure_queries.QUERIES, **learn_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**prepare_queries.SQL, **measure_queries.SQL, **learn_queries.SQL}
