"""A PySpark-native analytics engine for ordered, vector-valued trajectories."""
