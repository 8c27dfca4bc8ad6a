"""Spark-native near-duplicate, triage and corpus analytics."""
