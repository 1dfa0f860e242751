"""Plain-SQL (DuckDB dialect) restatements of every registered query, for oracle comparison.

They rebuild the clinical tables from the driver tables with the same column expressions as
``carelens.sources.driver`` and then answer each question in the most direct SQL form
(correlated subqueries with ORDER BY ... LIMIT 1, EXISTS, plain GROUP BY), independent of
the Spark plans.
"""
