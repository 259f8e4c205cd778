"""Spark-native analytics over a collected archive of pages, documents, vectors and work items."""
