"""gaugeline: Spark-native analytics for sparse, irregular monitoring data."""
