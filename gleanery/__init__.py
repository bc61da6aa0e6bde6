"""Spark-native engine for product-record enrichment and corpus preparation."""
