"""Query catalogue: each reference query as a plan over the driver tables, with its DuckDB equivalent."""
