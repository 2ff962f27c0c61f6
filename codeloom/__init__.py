"""Spark-native source-code graph analytics."""
