"""Spreadsheet-formula analytics on Spark DataFrames."""

from .plans.book import Book

__all__ = ["Book"]
