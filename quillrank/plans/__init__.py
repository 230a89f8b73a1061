"""All of the engine's queries and their SQL twins."""

from __future__ import annotations

from . import explanation_queries, interpretation_queries, landing_queries, oracle, oracle_v2, oracle_v3, oracle_v4, oracle_v5, queries_v2, queries_v3, queries_v4, queries_v5, registry_queries, report_queries, sweep_queries
from . import queries as queries_v1


def queries() -> dict:
    return queries_v1.queries() | queries_v2.queries() | queries_v3.queries() | queries_v4.queries() | queries_v5.queries() | report_queries.queries() | interpretation_queries.queries() | landing_queries.queries() | explanation_queries.queries() | sweep_queries.all_queries() | registry_queries.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | oracle_v2.oracle_sql() | oracle_v2.hybrid_sql() | oracle_v3.oracle_sql() | oracle_v4.oracle_sql() | oracle_v5.oracle_sql() | report_queries.oracle_sql() | interpretation_queries.oracle_sql() | landing_queries.oracle_sql() | explanation_queries.oracle_sql() | sweep_queries.oracle_sql() | registry_queries.oracle_sql()
