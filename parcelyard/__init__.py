"""Package-repository analytics on Spark."""
