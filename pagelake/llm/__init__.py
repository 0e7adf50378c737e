"""Operators for training-data pipelines."""

from .oracles import ORACLES
from .queries import queries


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries"]
