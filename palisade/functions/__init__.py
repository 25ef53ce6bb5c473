"""Column-valued helpers: text, dates, versions."""
