"""A Spark-native engine for document knowledge bases: clean, fingerprint, chunk, index, retrieve, evaluate."""
