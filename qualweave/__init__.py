"""Spark-native analysis of ordered symbol sequences with a known predictor."""
