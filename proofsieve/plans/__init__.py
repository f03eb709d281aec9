"""The library's queries, each with the same in SQL where SQL can express it."""

from proofsieve.plans import checks, investigations, queries, sources, state
from proofsieve.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checks", "investigations", "queries", "sources", "state"]
