"""Training-data operators: each takes DataFrames and returns DataFrames. Nothing else in the library imports this package."""
