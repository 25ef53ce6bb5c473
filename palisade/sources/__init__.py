"""Readers: evidence folders, CSV and workbook contents, JSON state."""
