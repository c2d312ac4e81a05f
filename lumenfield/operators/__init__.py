"""Relational and statistical operators; each takes and returns DataFrames."""
