"""A PySpark-native engine for timed text."""
