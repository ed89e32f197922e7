"""glyphmill: a PySpark-native code-intelligence and hybrid-search engine."""

__version__ = "0.1.0"
