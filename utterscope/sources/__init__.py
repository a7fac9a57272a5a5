"""Readers and writers for reports, labelled corpora and result tables."""
