"""A Spark-native engine for lexical analytics and assessment over text tables."""
