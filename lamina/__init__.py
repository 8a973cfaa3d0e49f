"""lamina: a PySpark-native engine for disclosure text and bitemporal evidence graphs."""
