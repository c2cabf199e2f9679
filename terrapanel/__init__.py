"""Spark-native analytics over spatial panels and dated interventions."""
