"""A Spark-native checked warehouse engine: bronze, silver and gold as DataFrame plans."""
