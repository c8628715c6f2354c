"""foralia: a Spark-native engine for rule-driven tax computation, legal version catalogues and legal retrieval."""
