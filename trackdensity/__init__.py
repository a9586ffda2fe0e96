"""Spark-native analytics for irregular tracks, gridded map series and their corrections."""
