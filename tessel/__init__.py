"""tessel: Spark-native retrieval and analytics over multimodal text."""
