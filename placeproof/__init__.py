"""placeproof: location-evidence analytics on Spark DataFrames and Structured Streaming."""
