"""tidewell: Spark-native evaluation and corpus preparation for language-model data."""
