"""orbweave: a PySpark-native engine for follow graphs, post statistics and spin models."""
