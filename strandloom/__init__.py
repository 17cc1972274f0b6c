"""Spark-native analytics for genome-editing design: sequences, annotations and alignments as DataFrames."""
