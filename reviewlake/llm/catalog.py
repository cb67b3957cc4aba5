"""The filled registry of this subpackage."""

from . import queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
