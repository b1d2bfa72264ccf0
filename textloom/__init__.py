"""Spark-native analytics over text: scanning, decoding, fact graphs and rules."""
