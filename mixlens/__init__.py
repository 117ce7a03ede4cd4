"""Sales-mix metrics on Spark."""
