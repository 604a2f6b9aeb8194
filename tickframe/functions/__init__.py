"""Column expressions that indicators share."""
