"""Registered queries and whole runs."""
