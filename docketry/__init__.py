"""docketry: record linkage and text analytics on Spark DataFrames."""
