"""PySpark-native analytics engine for text-pair and multi-option decision data."""
