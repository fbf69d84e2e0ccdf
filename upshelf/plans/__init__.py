"""Query catalogue (``catalog.queries``) and the DuckDB oracle (``oracle``)."""
