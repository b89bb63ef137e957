"""vellum: a PySpark-native engine for preparing historical-text training corpora."""

__version__ = "0.1.0"
