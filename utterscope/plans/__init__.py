"""Whole workflows, and the queries that run over the shared test tables."""
