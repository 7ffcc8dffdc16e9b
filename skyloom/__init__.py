"""Spark-native engine for synthetic sky catalogs and training-data pipelines."""
