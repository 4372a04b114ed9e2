"""marlstone: a PySpark-native engine for landed web listings."""
