"""meshlake: dense matrices, meshes, image stacks and their time series as Spark DataFrames."""
