"""PySpark-native analytics engine for long-format measurement data."""
