"""Document retrieval, knowledge graphs and training-data preparation on Spark."""
