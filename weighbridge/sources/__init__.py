"""Schemas, readers, writers and fixtures."""
