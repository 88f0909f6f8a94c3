"""Workbooks as JSON: tagged cells, tables, names, sources and hidden rows."""

from __future__ import annotations

import datetime as dt
import json

from ..formula.nodes import CellRef, Node, RangeRef
from ..formula.parser import parse
from ..values import Error, Grid, is_num, to_serial
from ..workbook import Cell, Cycles, TableDef, Workbook


def untagged(value: dict | None) -> object:
    """A tagged value; dates and times as serials."""
    if value is None:
        return None
    kind, v = value["type"], value.get("value")
    if kind in ("Empty", "Pending"):
        return None
    if kind == "Int":
        return float(v)
    if kind == "Error":
        return Error(v)
    if kind == "Date":
        return to_serial(dt.date.fromisoformat(v))
    if kind == "DateTime":
        return to_serial(dt.datetime.fromisoformat(v))
    if kind == "Time":
        return to_serial(dt.time.fromisoformat(v))
    if kind == "Duration":
        return v / 86400
    if kind == "Array":
        return Grid([[untagged(x) for x in row] for row in v])
    return v


def tagged(v: object) -> dict:
    if isinstance(v, Error):
        return {"type": "Error", "value": v.kind}
    if isinstance(v, bool):
        return {"type": "Boolean", "value": v}
    if is_num(v):
        return {"type": "Number", "value": float(v)}
    return {"type": "Empty"} if v is None else {"type": "Text", "value": str(v)}


def address(a: dict) -> Node:
    if (a["start_row"], a["start_col"]) == (a["end_row"], a["end_col"]):
        return CellRef(a["sheet"], a["start_row"], a["start_col"])
    return RangeRef(a["sheet"], a["start_row"], a["start_col"], a["end_row"], a["end_col"])


def load(text: str, cycles: Cycles | None = None, seed: int = 0) -> Workbook:
    doc, book = json.loads(text), Workbook(cycles, seed)
    for name, s in doc.get("sheets", {}).items():
        sheet = book._sheet(name)
        for c in s.get("cells", []):
            if "formula" in c and c["formula"]:
                sheet.cells[(c["row"], c["col"])] = Cell(None, c["formula"], parse(c["formula"]))
            elif (v := untagged(c.get("value"))) is not None:
                sheet.cells[(c["row"], c["col"])] = Cell(v)
        for t in s.get("tables", []):
            r1, c1, r2, c2 = t["range"]
            top = r1 if t.get("header_row", True) else r1 - 1
            book.tables[t["name"].lower()] = TableDef(name, top, c1, r2, c2, t["headers"], t["totals_row"])
        for n in s.get("named_ranges", []):
            book.names[(name.lower() if n.get("scope") == "sheet" else None, n["name"].lower())] = address(n["address"])
        sheet.hidden = {*s.get("row_hidden_manual", []), *s.get("row_hidden_filter", [])}
    for n in doc.get("defined_names", []):
        d = n["definition"]
        target = address(d["address"]) if d["type"] == "range" else untagged(d["value"]) if d["type"] == "literal" else parse(d["formula"])
        book.names[(n["scope_sheet"].lower() if n.get("scope") == "sheet" else None, n["name"].lower())] = target
    for s in doc.get("sources", []):
        book.define_source(s["name"], untagged(s.get("value")))
    return book


def dump(book: Workbook) -> str:
    sheets: dict[str, dict] = {}
    for name, s in book.sheets.items():
        cells = []
        for (r, c), cell in sorted(s.cells.items()):
            one: dict[str, object] = {"row": r, "col": c, "value": tagged(book.value(name, r, c))}
            if cell.formula:
                one["formula"] = cell.formula
            cells.append(one)
        tables = [{"name": n, "range": [t.row1, t.col1, t.row2, t.col2], "headers": t.headers, "header_row": True, "totals_row": t.totals} for n, t in book.tables.items() if t.sheet == name]
        rows, cols = book.used(name)
        sheets[name] = {"dimensions": [rows, cols], "cells": cells, "tables": tables, "row_hidden_manual": sorted(s.hidden)}
    names = []
    for (sheet, n), target in book.names.items():
        one = {"name": n, "scope": "sheet" if sheet else "workbook"} | ({"scope_sheet": sheet} if sheet else {})
        if isinstance(target, CellRef):
            one["definition"] = {"type": "range", "address": {"sheet": target.sheet, "start_row": target.row, "start_col": target.col, "end_row": target.row, "end_col": target.col}}
        elif isinstance(target, RangeRef):
            one["definition"] = {"type": "range", "address": {"sheet": target.sheet, "start_row": target.row1, "start_col": target.col1, "end_row": target.row2, "end_col": target.col2}}
        elif isinstance(target, Node):
            from ..workbook import unparse

            one["definition"] = {"type": "formula", "formula": "=" + unparse(target)}
        else:
            one["definition"] = {"type": "literal", "value": tagged(target)}
        names.append(one)
    return json.dumps({"version": 1, "sheets": sheets, "defined_names": names})


def cells_frame(spark, path: str):
    """Cells of many JSON workbooks at once, read by Spark: (file, sheet, row, col, formula, value)."""
    from pyspark.sql import functions as F

    kind = "struct<type:string,value:string>"
    schema = f"sheets map<string,struct<cells:array<struct<row:int,col:int,formula:string,value:{kind}>>>>"
    books = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    sheets = books.select("file", F.explode("sheets").alias("sheet", "s"))
    return sheets.select("file", "sheet", F.explode("s.cells").alias("c")).select("file", "sheet", "c.row", "c.col", "c.formula", "c.value")
