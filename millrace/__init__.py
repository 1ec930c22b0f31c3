"""Spark-native mobile attribution and revenue analytics."""
