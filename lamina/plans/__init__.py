"""Named queries over the test tables, each beside equivalent SQL."""

from . import checks  # noqa: F401  registers its queries
from .layers import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
