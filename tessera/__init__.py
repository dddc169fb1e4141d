"""tessera: a PySpark-native engine for code graphs, change history, notes and text corpora."""
