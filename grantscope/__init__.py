"""Spark-native analytics over project trees, and over ordinary tables."""
