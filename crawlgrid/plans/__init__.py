"""Registered queries: each binds adapter views to an operator and carries an
independent DuckDB oracle where the result can be written in SQL."""
