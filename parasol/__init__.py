"""Spark-native shade routing analytics and training-data operators."""
