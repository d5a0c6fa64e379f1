"""Spark-native search, cleaning and matching of songs and other short texts."""
