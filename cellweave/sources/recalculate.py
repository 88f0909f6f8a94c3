"""Load a workbook file, evaluate it and write the results back."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

from ..values import Error
from .json_workbook import dump, load
from .xlsx import read_xlsx, write_xlsx


def recalculate_file(path: str, out: str | None = None) -> dict[str, object]:
    """A summary: formulas, errors by kind and the path written. The file is replaced only when whole."""
    target = Path(out or path)
    xlsx = str(path).lower().endswith(".xlsx")
    book = read_xlsx(path) if xlsx else load(Path(path).read_text())
    values = book.evaluate_all()
    staged = target.with_name(target.name + ".part")
    if xlsx:
        write_xlsx(book, staged)
    else:
        staged.write_text(dump(book))
    os.replace(staged, target)
    formulas = sum(c.formula is not None for s in book.sheets.values() for c in s.cells.values())
    return {"formulas": formulas, "errors": dict(Counter(v.kind for v in values.values() if isinstance(v, Error))), "path": str(target)}
