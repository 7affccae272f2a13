"""Security-telemetry analytics as PySpark DataFrame operators."""

from threatlake.config import Config

__all__ = ["Config"]
