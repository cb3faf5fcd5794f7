"""Provider quality and spending analytics on Spark."""
