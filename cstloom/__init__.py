"""PySpark-native analytics over source code, syntax trees, chunks and vectors."""
