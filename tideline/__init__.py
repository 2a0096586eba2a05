"""A PySpark-native engine for ordered, versioned key-value logs."""
