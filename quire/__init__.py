"""quire: a Spark-native engine for long-form documents and training corpora."""
