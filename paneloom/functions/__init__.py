"""Column expressions: three-valued logic, text, dates, set rollups."""
