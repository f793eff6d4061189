"""Spark-native document analytics: DataFrame operators that hold at cluster scale."""
