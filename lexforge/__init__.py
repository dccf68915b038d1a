"""A PySpark-native engine for building and querying text-retrieval corpora."""
