"""Spark-native partitioning, scoring and comparison of 3-D point clouds."""
