"""The analytics operators: DataFrames and parameters in, one lazy DataFrame out."""
