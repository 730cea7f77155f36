"""All named queries in one place."""

from cohortlens.plans import model_queries, set_queries, table_queries
from cohortlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "model_queries", "set_queries", "table_queries"]
