"""A Spark-native engine for predicate resolution and federated graph queries."""
