"""Relational operators that formulas compile to."""
