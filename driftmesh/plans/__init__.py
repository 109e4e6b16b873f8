"""Registered queries, their SQL and composite pipelines."""
