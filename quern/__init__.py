"""quern: corpus building, hybrid search and retrieval evaluation as Spark DataFrame programs."""

__version__ = "0.1.0"
