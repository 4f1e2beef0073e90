"""Activity and retrieval analytics on Spark."""
