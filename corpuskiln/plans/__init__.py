"""Registered queries that are put together from several operators."""
