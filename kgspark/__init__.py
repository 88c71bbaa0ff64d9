"""kgspark: document -> evidence -> knowledge-graph analytics on Spark DataFrames."""
