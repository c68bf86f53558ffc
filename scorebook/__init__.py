"""Play-by-play sports analytics as Spark DataFrames."""
