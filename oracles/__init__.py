"""Independent DuckDB formulations of the registered queries."""
