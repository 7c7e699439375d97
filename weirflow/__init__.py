"""A PySpark-native analytics engine: record ETL, windows, streams and training-data operators."""
