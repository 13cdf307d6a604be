"""The operation tree, its rewrites and its compilation to DataFrames."""
