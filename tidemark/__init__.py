"""Market-data analytics as Spark jobs: every operator takes DataFrames and returns a DataFrame."""
