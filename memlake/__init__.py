"""A PySpark-native analytics engine for decaying, richly annotated memory records."""
