"""Readers and writers of workbooks and tables."""

from .csv_files import read_csv, write_csv
from .json_workbook import dump, load
from .recalculate import recalculate_file
from .xlsx import read_xlsx, write_xlsx

__all__ = ["dump", "load", "read_csv", "read_xlsx", "recalculate_file", "write_csv", "write_xlsx"]
