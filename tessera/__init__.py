"""Spark-native haplotype, sequence and training-data analytics."""
