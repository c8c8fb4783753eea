"""Spark-native hybrid ranking and analytics."""
