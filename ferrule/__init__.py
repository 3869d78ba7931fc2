"""Spark-native engine for building, querying and auditing a document knowledge base."""
