"""lexloom: a Spark-native engine for large dictionary corpora."""
