"""Column expressions: text, dates, durations, quality and exact numerics."""
