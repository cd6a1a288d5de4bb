"""goldseam: a PySpark-native engine for measuring document retrieval at scale."""
