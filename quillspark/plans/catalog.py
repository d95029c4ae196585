"""Registered queries over the shared tables, with the SQL each must agree with."""

from __future__ import annotations

from quillspark.plans import audit_queries, case_queries, contract_queries, decision_queries, gate_queries, kernel_queries, measure_queries, meeting_queries

_PARTS = (decision_queries, audit_queries, measure_queries, gate_queries, kernel_queries, case_queries, contract_queries, meeting_queries)


def flagship(spark, sf_dir):
    return decision_queries.cascade_decision(spark, sf_dir)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
