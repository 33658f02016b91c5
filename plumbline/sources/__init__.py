"""Reading, writing and storing tables and results."""
