"""Registered queries over the given tables, each with its SQL where there is one."""

from corpusloom.plans import corpus, evaluation, retrieval, streams, web  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
