"""Registered queries; importing this package fills the registry."""

from . import diffs, feedback, redaction, review, scan, vectors  # noqa: F401
from . import streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
