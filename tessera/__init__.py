"""tessera: a PySpark-native engine for daily-bar market research and corpus work."""
