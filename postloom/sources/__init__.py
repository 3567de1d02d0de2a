"""Readers and writers."""

from postloom.sources.tables import read_table

__all__ = ["read_table"]
