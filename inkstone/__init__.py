"""inkstone: a PySpark-native engine for word-processor and web document analytics."""
