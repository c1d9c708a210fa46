"""Spark-native engine for signature simulation, discovery and benchmarking."""
