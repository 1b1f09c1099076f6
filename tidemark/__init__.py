"""A PySpark-native engine for ranking, filtering and querying a corpus of links and texts."""
