"""quern: a Spark-first engine for building, auditing and evaluating text corpora."""

__version__ = "0.1.0"
