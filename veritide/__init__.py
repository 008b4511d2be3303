"""Evidence-first retrieval analytics and training-data operators on Spark DataFrames."""
