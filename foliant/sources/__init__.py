"""Readers and sinks."""

from foliant.sources.tables import read_table

__all__ = ["read_table"]
