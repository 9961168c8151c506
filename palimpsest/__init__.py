"""Personal-memory retrieval, its evaluation and training-corpus building on Spark DataFrames."""
