"""Session analytics and artifact scoring on Spark DataFrames."""
