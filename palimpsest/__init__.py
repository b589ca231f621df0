"""Spark-native engine for long-term conversational memory: records in, ranked and maintained evidence out."""
