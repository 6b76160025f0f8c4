"""Spark-native preparation and analysis of text corpora for punctuation and casing restoration."""
