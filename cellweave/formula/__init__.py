"""Formula text: syntax tree and parser."""

from .parser import FormulaError, parse

__all__ = ["FormulaError", "parse"]
