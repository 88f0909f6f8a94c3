"""Information functions."""

from __future__ import annotations

import math

from ..formula.nodes import CellRef, RangeRef, SpillRef, TableRef
from ..values import NA, Error, Grid, Lambda, corner, is_num, number
from .registry import each, lazy, whole


def kind(names, test):
    each(names, 1, errors=True)(test)


kind("ISNUMBER", is_num)
kind("ISTEXT", lambda v: isinstance(v, str))
kind("ISNONTEXT", lambda v: not isinstance(v, str))
kind("ISLOGICAL", lambda v: isinstance(v, bool))
kind("ISBLANK", lambda v: v is None)
kind("ISERROR", lambda v: isinstance(v, Error))
kind("ISERR", lambda v: isinstance(v, Error) and v.kind != NA)
kind("ISNA", lambda v: isinstance(v, Error) and v.kind == NA)
each("ISEVEN", 1)(lambda v: math.trunc(number(v)) % 2 == 0)
each("ISODD", 1)(lambda v: math.trunc(number(v)) % 2 == 1)
each("NA", 0)(lambda: Error(NA))
each("T", 1)(lambda v: v if isinstance(v, str) else "")


@whole("N", 1)
def n(v):
    v = corner(v)
    return v if is_num(v) else int(v) if isinstance(v, bool) else 0


@whole("TYPE", 1, errors=True)
def type_(v):
    if isinstance(v, Grid) and (v.height > 1 or v.width > 1):
        return 64
    v = corner(v)
    if isinstance(v, Error):
        raise v
    return 4 if isinstance(v, bool) else 2 if isinstance(v, str) else 128 if isinstance(v, Lambda) else 1


#: Numbers of the error kinds.
ERROR_TYPES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CALC!": 14}


@each("ERROR.TYPE", 1, errors=True)
def error_type(v):
    if not isinstance(v, Error) or v.kind not in ERROR_TYPES:
        raise Error(NA)
    return ERROR_TYPES[v.kind]


@lazy("ISREF", 1)
def isref(interp, frame, args):
    return isinstance(args[0], (CellRef, RangeRef, TableRef, SpillRef)) or interp.reference(args[0], frame) is not None


each("ISFORMULA", 1, errors=True)(lambda v: False)


@lazy("FORMULATEXT", 1)
def formulatext(interp, frame, args):
    ref = interp.reference(args[0], frame)
    found = interp.formula_at(ref) if ref else None
    if found is None:
        raise Error(NA)
    return found


@lazy("SHEET", 0, 1)
def sheet(interp, frame, args):
    ref = interp.reference(args[0], frame) if args else None
    return interp.sheet_number(ref.sheet if ref and ref.sheet else frame.sheet)


@lazy("SHEETS", 0, 1)
def sheets(interp, frame, args):
    return 1 if args else interp.sheet_count()
