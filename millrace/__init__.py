"""millrace: a PySpark-native engine for preparing, searching and measuring text corpora."""

__version__ = "0.1.0"
