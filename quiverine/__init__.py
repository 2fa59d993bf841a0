"""Vector search and multimodal analytics on Spark DataFrames."""
