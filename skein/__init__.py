"""skein: a PySpark-native engine for session logs, event streams, text and engineering records."""

__version__ = "0.1.0"
