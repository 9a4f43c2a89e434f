"""brindle: Spark-native retrieval, knowledge analytics and corpus preparation."""
