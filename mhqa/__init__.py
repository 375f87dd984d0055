"""mhqa: a Spark-native engine for nested, multilingual multi-hop QA datasets."""

__version__ = "0.1.0"
