"""Spark-native sequence sketching, seeding and mapping."""
