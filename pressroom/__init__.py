"""Spark-native analytics over a deduplicated, searchable news corpus."""

from .config import Settings
from .errors import PressroomError

__all__ = ["PressroomError", "Settings"]
