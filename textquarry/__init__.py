"""textquarry: a Spark-native engine for document and knowledge-base analytics."""

__version__ = "0.1.0"
