"""Spark-native interval, evaluation and attribution analytics, and training-data operators."""
