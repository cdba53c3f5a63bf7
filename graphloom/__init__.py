"""A Spark-native engine for knowledge graphs over tables."""
