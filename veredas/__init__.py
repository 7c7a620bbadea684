"""Learning analytics on PySpark DataFrames."""
