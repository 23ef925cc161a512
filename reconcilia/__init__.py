"""Bank-statement analytics on Spark."""
