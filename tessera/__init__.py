"""Property-graph, findings and text analytics on PySpark DataFrames."""
