"""tidemark: probabilistic time-series evaluation and data preparation on Spark."""
