"""DuckDB statements that the registered queries are checked against."""
