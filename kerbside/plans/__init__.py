"""Composed jobs: the query catalogue, its DuckDB oracles and the whole job."""
