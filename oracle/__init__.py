"""SQL twins of the registered queries, written for DuckDB on the same tables."""
