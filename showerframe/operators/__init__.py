"""The operators of the model, each a function from DataFrames to DataFrames."""
