"""headrace: river-flow, water and electricity-demand analytics on Spark DataFrames."""
