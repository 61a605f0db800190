"""SQL twins of the registered queries, for comparison in DuckDB."""
