"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from evidentia.plans import catalogue_queries, intake_oracle, intake_queries, oracle, validation_oracle


def queries() -> dict:
    return catalogue_queries.QUERIES | intake_queries.QUERIES


def oracle_sql() -> dict:
    return oracle.ORACLES | intake_oracle.ORACLES | validation_oracle.ORACLES
