"""litspark: a PySpark-native engine for literature analytics."""

__version__ = "0.1.0"
