"""Spark-native analytics for finding and ranking short moments in long, time-coded recordings."""
