"""Formulas over streams."""

from .windows import column_stream, windowed

__all__ = ["column_stream", "windowed"]
