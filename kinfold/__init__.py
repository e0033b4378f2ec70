"""kinfold: leakage-aware corpus analytics on Spark DataFrames."""
