"""Single pipeline steps, each a function from DataFrames to DataFrames."""
