"""Text-analytics and information-retrieval operators on Spark DataFrames."""
