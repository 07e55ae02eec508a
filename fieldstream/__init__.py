"""Spark-native analytics over geotagged sensor readings."""
