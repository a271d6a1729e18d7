"""The registered queries and their oracle SQL."""

from . import fixtures, relations, scans, streams

QUERIES = {**scans.QUERIES, **relations.QUERIES, **streams.QUERIES, **fixtures.QUERIES}
ORACLE_SQL = {**scans.ORACLE_SQL, **relations.ORACLE_SQL, **streams.ORACLE_SQL, **fixtures.ORACLE_SQL}
