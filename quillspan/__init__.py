"""Spark-native passage linkage: parse, normalise, match, locate, map back, plan."""
