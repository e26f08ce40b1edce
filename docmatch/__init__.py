"""docmatch: batch matching of hierarchical text collections as lazy Spark plans."""

from docmatch.session import configure

__all__ = ["configure"]
