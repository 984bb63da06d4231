"""The same operators on streaming DataFrames."""
