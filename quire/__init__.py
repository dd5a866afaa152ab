"""Spark-native data binding, catalogue publishing and training-data preparation."""
