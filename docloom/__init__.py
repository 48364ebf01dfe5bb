"""docloom: document-intelligence and analytics operators on Spark DataFrames."""
