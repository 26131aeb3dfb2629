"""PySpark-native network-flow assembly, scoring and alert analytics."""
