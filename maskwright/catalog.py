"""All queries that stand by themselves, and their SQL."""

from .plans import planted, queries

QUERIES = queries.QUERIES | planted.QUERIES
ORACLE = queries.ORACLE | planted.ORACLE
