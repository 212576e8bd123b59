"""tessera: a PySpark-native engine for block-structured numeric data."""
