"""lexisift: a PySpark-native analytics engine for question/answer corpora."""

__version__ = "0.1.0"
