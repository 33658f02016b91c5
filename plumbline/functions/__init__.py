"""Column expressions and schema rules shared by all operators."""
