"""Typed scans, driver-table adapters and the validated loader."""

from storeline.sources.tables import Tables, conform, read_table, read_tables, write_tables  # noqa: F401
