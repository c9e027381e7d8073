"""weftline: a Spark-first engine that turns newsletter messages into one deduplicated list of stories."""

__version__ = "0.1.0"
