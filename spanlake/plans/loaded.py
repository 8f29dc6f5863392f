"""Importing this module registers every query of the catalogue."""

from spanlake.plans import interval_queries, more_queries, relational_queries, rule_queries, source_queries, stream_queries, text_queries, validation_queries  # noqa: F401
