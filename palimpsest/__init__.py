"""A PySpark-native engine for versioned documents: change detection, section diffs, retrieval analytics."""
