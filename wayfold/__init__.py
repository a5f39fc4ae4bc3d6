"""Spark-native analytics for multimodal journey planning."""
