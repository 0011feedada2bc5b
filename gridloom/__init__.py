"""Spreadsheet-shaped data to clean, queryable tables, as Spark jobs."""
