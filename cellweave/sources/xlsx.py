"""Office Open XML workbooks, read and written with the standard library."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from ..formula.parser import FormulaError, column_letters, column_number, parse
from ..values import Error, is_num, number_text
from ..workbook import Cell, Cycles, TableDef, Workbook, _offset, unparse

#: The name spaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    return int(m[2]), column_number(m[1])


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)).iter(f"{PACKAGE}Relationship"):
        target = r.get("Target")
        whole = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in whole:
            whole = re.sub(r"[^/]+/\.\./", "", whole, count=1)
        out[r.get("Id")] = whole
    return out


def read_xlsx(path, cycles: Cycles | None = None) -> Workbook:
    """Values, formulas (shared families included), tables, names, hidden rows and iteration settings."""
    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read("xl/workbook.xml"))
        calc = root.find(f"{MAIN}calcPr")
        if cycles is None and calc is not None and calc.get("iterate") in ("1", "true"):
            cycles = Cycles("iterate", int(calc.get("iterateCount", "100")), float(calc.get("iterateDelta", "0.001")))
        book = Workbook(cycles)
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        links, listed = _relations(z, "xl/workbook.xml"), []
        for s in root.iter(f"{MAIN}sheet"):
            listed.append(s.get("name"))
            _read_sheet(z, links[s.get(f"{RELS}id")], book, s.get("name"), strings)
        for n in root.iter(f"{MAIN}definedName"):
            home = n.get("localSheetId")
            try:
                book.names[(listed[int(home)].lower() if home else None, n.get("name").lower())] = parse(n.text or "")
            except FormulaError:
                continue
    return book


def _read_sheet(z: zipfile.ZipFile, part: str, book: Workbook, name: str, strings: list[str]) -> None:
    sheet, shared = book._sheet(name), {}
    root = ET.fromstring(z.read(part))
    for row in root.iter(f"{MAIN}row"):
        if row.get("hidden") in ("1", "true"):
            sheet.hidden.add(int(row.get("r")))
        for c in row.iter(f"{MAIN}c"):
            at, kind = place(c.get("r")), c.get("t", "n")
            f, v = c.find(f"{MAIN}f"), c.find(f"{MAIN}v")
            formula = f.text if f is not None else None
            if f is not None and f.get("t") == "shared":
                if formula:
                    shared[f.get("si")] = (at, parse(formula))
                else:
                    (r0, c0), tree = shared[f.get("si")]
                    formula = unparse(_offset(tree, at[0] - r0, at[1] - c0))
            if formula:
                try:
                    sheet.cells[at] = Cell(None, "=" + formula, parse(formula))
                except FormulaError:
                    sheet.cells[at] = Cell(Error("#ERROR!"))
                continue
            text = v.text if v is not None else None
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            if text is None:
                continue
            value = strings[int(text)] if kind == "s" else text if kind in ("str", "inlineStr", "d") else text == "1" if kind == "b" else Error(text) if kind == "e" else float(text)
            sheet.cells[at] = Cell(value)
    for target in _relations(z, part).values():
        if "/tables/" in target:
            t = ET.fromstring(z.read(target))
            a, b = t.get("ref").split(":")
            heads = [col.get("name") for col in t.iter(f"{MAIN}tableColumn")]
            (r1, c1), (r2, c2) = place(a), place(b)
            top = r1 if t.get("headerRowCount", "1") != "0" else r1 - 1
            book.tables[t.get("displayName", t.get("name")).lower()] = TableDef(name, top, c1, r2, c2, heads, int(t.get("totalsRowCount", "0")) > 0)


def write_xlsx(book: Workbook, path) -> None:
    """Values, formulas with their results, names and hidden rows."""
    names = book.sheet_names()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{RELS[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        defined = ""
        for (home, n), target in book.names.items():
            body = unparse(target) if hasattr(target, "walk") else number_text(target) if is_num(target) else f'"{target}"'
            local = f' localSheetId="{[x.lower() for x in names].index(home)}"' if home else ""
            defined += f'<definedName name="{escape(n)}"{local}>{escape(body)}</definedName>'
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELS[1:-1]}"><sheets>{sheets}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{RELS[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(book, n))


def _sheet_xml(book: Workbook, name: str) -> str:
    rows: dict[int, list[str]] = {}
    sheet = book.sheets[name]
    for (r, c), cell in sorted(sheet.cells.items()):
        v = book.value(name, r, c)
        formula = f"<f>{escape(cell.formula[1:])}</f>" if cell.formula else ""
        ref = f"{column_letters(c)}{r}"
        if isinstance(v, Error):
            body = f'<c r="{ref}" t="e">{formula}<v>{v.kind}</v></c>'
        elif isinstance(v, bool):
            body = f'<c r="{ref}" t="b">{formula}<v>{int(v)}</v></c>'
        elif is_num(v):
            body = f'<c r="{ref}">{formula}<v>{float(v)!r}</v></c>'
        elif formula:
            body = f'<c r="{ref}" t="str">{formula}<v>{escape(str(v))}</v></c>'
        else:
            body = f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        rows.setdefault(r, []).append(body)
    for r in sheet.hidden:
        rows.setdefault(r, [])
    lines = "".join(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r in sheet.hidden else ""}>{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>'
