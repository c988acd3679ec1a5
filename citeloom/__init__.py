"""Spark-native engine for auditing quotations and preparing text corpora."""
