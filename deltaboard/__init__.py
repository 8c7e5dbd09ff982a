"""Change-only outputs from high-volume transit prediction feeds, on PySpark."""

from deltaboard.settings import Settings

__all__ = ["Settings"]
