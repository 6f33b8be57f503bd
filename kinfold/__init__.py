"""kinfold: multi-source entity resolution on Spark DataFrames."""
