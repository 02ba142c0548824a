"""folioforge: a PySpark-native engine for bibliographic imprint analytics."""
