"""Spark-native analytics for grader-versus-human agreement."""
