"""Bay-occupancy analytics on Spark: sources, operators, plans, streams."""
