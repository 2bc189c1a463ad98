"""A PySpark-native engine for linear text classification and sentence embedding."""
