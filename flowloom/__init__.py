"""Network-threat analytics on Spark."""
