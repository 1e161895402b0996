"""marginalia: analytics over bounded document corpora, on PySpark."""

__all__ = ["session"]
