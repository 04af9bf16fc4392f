"""millrace: a PySpark-native engine for curating question/answer training data."""
