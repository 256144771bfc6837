"""Spark-native analytics engine for opinion content and market data."""
