"""Spark-native analytics for RNA-interference sequencing data."""
