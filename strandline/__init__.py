"""Spark-native analytics for ordered frame sequences, signals and catalogues."""
