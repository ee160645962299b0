"""A Spark-native engine for document knowledge assets: chunks, entities, relations, two-level graphs and retrieval."""
