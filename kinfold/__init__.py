"""Spark-native record linkage, survivorship and corpus preparation."""
