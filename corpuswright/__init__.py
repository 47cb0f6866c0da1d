"""PySpark-native curation of text and code corpora."""
