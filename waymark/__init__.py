"""waymark: a Spark-native engine for timestamped records, labelled points, rasters and trajectories."""
