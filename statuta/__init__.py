"""statuta: a PySpark-native text analytics and hybrid retrieval engine."""
