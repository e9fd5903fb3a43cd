"""A PySpark-native engine for corpus analytics."""
