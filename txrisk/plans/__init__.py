"""Named query plans over the provided tables and their DuckDB oracles."""
