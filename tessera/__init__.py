"""Spark-native engine for evidence graphs, hybrid retrieval and change-history analytics."""
