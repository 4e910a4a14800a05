"""tidemark: security-finding and corpus analytics expressed on Spark DataFrames."""
