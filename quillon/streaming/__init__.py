"""Bounded ingest and arrival models."""
