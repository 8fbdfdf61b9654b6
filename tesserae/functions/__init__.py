"""Column expressions and driver-side numbers."""
