"""PySpark-native engine for a large URL frontier."""
