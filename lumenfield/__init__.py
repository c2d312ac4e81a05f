"""Spark-native spatial hotspot analytics over labelled 3D point sets."""
