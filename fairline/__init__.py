"""Spark-native odds analytics: DataFrame operators over bookmaker prices."""
