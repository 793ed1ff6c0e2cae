"""All queries of the library by name, with the SQL that checks them."""

from clearsift.plans import planted_queries, fixture_queries, source_queries

QUERIES = planted_queries.QUERIES | fixture_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = planted_queries.ORACLE_SQL | fixture_queries.ORACLE_SQL | source_queries.ORACLE_SQL
