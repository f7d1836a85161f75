"""Spark-native analytics over procurement-style notice, award and document tables."""
