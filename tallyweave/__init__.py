"""Document-to-catalogue analytics on Spark."""
