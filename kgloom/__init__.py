"""Spark-native knowledge-graph analytics and training-data operators."""
