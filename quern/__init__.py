"""quern: a Spark-first engine for text corpora, usage analytics and vectors."""

__version__ = "0.1.0"
