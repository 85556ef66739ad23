"""SQL twins of the registered queries, for the DuckDB check."""
