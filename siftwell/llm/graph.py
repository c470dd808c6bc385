"""Connected parts of a graph."""

from ..graph import components

__all__ = ["components"]
