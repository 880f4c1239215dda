"""Spark-native canopy, corridor and growth analytics."""
