"""Spark-native analytics for 3D Gaussian point clouds."""
