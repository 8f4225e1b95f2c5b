"""Route facts on Spark: world data, requirements, topology, routes, bounds and facts as DataFrames."""
