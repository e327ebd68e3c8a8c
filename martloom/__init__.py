"""Martloom: lazy PySpark operators for multi-location commerce analytics."""

from martloom.session import tune
from martloom.sources.snapshot import Snapshot

__all__ = ["Snapshot", "tune"]
