"""A PySpark-native engine for document corpora."""
