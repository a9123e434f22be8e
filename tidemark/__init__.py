"""tidemark: a PySpark-native engine for anomaly detection over large collections of time series."""

__version__ = "0.1.0"
