"""DuckDB statements that give the same results as the registered queries."""
