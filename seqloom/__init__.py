"""Statistics and data preparation for tables of aligned categorical sequences, as Spark DataFrames."""
