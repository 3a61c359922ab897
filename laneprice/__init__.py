"""Spark-native analytics over price series, tax tables, points, lines and trips."""
