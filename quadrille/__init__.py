"""Spark-native geospatial tiling analytics."""
