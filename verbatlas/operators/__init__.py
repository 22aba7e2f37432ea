"""Index building, expansion and search over DataFrames."""
