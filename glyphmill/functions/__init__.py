"""Column expressions and symbol scanners."""
