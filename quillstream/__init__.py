"""quillstream: a Spark-first engine for bibliographic and web-document collections."""

__version__ = "0.1.0"
