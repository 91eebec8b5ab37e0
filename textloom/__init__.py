"""A Spark-native document and vector analytics engine."""
