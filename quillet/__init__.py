"""A PySpark-native store and query engine for short texts and their embeddings."""
