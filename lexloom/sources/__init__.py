"""Readers that Spark lacks."""
