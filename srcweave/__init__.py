"""Spark-native code-graph analytics: every operator is DataFrame(s) -> DataFrame."""
