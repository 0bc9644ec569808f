"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from perigee.plans import catalog, telemetry

_PARTS = (telemetry, catalog)


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.ORACLES.items()}
