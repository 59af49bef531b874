"""Trigram text search over Spark DataFrames."""

__version__ = "0.2.1"


def version() -> str:
    return __version__
