"""Column expressions over single rows."""
