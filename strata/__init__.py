"""Spark-native analytics over structurally versioned data."""
