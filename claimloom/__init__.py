"""Spark-native analytics over evidence graphs: claims, edges, beliefs, retrieval."""
