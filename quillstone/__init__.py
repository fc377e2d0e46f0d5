"""Spark-native document extraction and analytics operators."""
