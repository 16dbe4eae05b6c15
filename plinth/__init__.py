"""plinth: Spark-native analytics over source code and labelled code changes."""
