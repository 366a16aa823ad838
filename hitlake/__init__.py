"""hitlake: detector-hit analytics on Spark."""
