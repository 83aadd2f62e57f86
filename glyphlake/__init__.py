"""A PySpark-native engine for document records and training-data pipelines."""
