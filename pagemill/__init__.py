"""pagemill: a PySpark-native engine for collections of web pages and text documents."""

__version__ = "0.1.0"
