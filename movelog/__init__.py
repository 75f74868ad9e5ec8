"""Spark-native toolkit for two-player game logs: parse, summarise, sample, score, merge."""
