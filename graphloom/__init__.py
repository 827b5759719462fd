"""graphloom: a PySpark-native engine for graph retrieval data processing."""
