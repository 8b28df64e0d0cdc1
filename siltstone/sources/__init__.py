"""Readers: the driver tables, report files and polymorphic query files."""
