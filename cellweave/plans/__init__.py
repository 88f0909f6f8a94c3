"""Compilation of formulas to Spark expressions and plans."""
