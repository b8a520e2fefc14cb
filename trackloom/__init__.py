"""Analytics of GPS trajectories and road networks on Spark DataFrames."""
