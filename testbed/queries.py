"""All registered queries."""

from testbed import queries_jobs, queries_models, queries_rounds, queries_stores, queries_units, queries_vectors  # noqa: F401
from testbed.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
