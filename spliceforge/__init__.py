"""Spark-native isoform analytics: DataFrame operators for long-read transcriptomes."""
