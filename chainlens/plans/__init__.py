"""Registry of named queries (``catalog.QUERIES``) and their DuckDB oracle SQL (``oracle.ORACLE``)."""
