"""lodestone: a document-retrieval and analytics engine written for PySpark."""

__version__ = "0.1.0"
