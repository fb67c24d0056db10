"""Error families raised by the engine."""

from __future__ import annotations


class PressroomError(Exception):
    """Base of every error raised on purpose by this package."""


class EmbeddingMismatch(PressroomError):
    """Vectors disagree with the configured model or dimension."""


class FeedError(PressroomError):
    """A raw feed breaks the contract (unknown fetch method, no order, bad status)."""


class WebhookRefused(PressroomError):
    """A monitor registration carries a webhook that may not be called."""


class ScorerMissing(PressroomError):
    """A brief or a sentiment score was asked for without a scorer."""


class ConfigurationError(PressroomError):
    """The session lacks a setting that the engine cannot choose itself."""
