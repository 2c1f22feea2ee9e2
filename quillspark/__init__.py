"""A PySpark-native engine for document processing and retrieval. Importing it has no side effects."""
