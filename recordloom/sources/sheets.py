"""Excel workbooks (Office Open XML) without a package: the first sheet's cells as text, and tables as workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

#: Names of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Signs that XML can't have, and most signs of a cell.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
LONGEST = 32_767


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for sign in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(sign) - 64
    return n - 1


def column_name(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(element: ET.Element) -> str:
    """A string's text without phonetic readings."""
    return "".join(t.text or "" for part in element if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def read_rows(data: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet; whole numbers have no decimals, missing cells are blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = [_text(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        first = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet").get(f"{{{_OFFICE}}}id")
        target = links[first]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                    value, kind = cell.findtext(f"{_MAIN}v") or "", cell.get("t")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(cell.find(f"{_MAIN}is"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind in (None, "n"):
                        value = re.sub(r"^(-?\d+)\.0+$", r"\1", value)
                    cells[column_number(cell.get("r")) if cell.get("r") else place] = value
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


def read_table(data: bytes) -> Iterator[dict[str, str]]:
    """Rows below the header as records; blank header cells are named by their column, repeated ones numbered."""
    rows = read_rows(data)
    names: list[str] = []
    for i, name in enumerate(next(rows, [])):
        name = name.strip() or f"Unnamed: {i}"
        names.append(name if name not in names else f"{name}.{sum(n == name or n.startswith(f'{name}.') for n in names)}")
    for row in rows:
        if any(row):
            yield dict(zip(names, [*row, *[""] * (len(names) - len(row))], strict=False))


def write_table(names: list[str], rows: Iterable[Iterable]) -> bytes:
    """A workbook with one sheet of text cells; signs that the format can't have are left out."""

    def line(number: int, cells: Iterable) -> str:
        texts = ((i, _BAD.sub("", "" if c is None else str(c))) for i, c in enumerate(cells))
        return f'<row r="{number}">' + "".join(f'<c r="{column_name(i)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(t)}</t></is></c>' for i, t in texts if t) + "</row>"

    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name="Records" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for number, cells in enumerate([names], 1):
                sheet.write(line(number, cells).encode())
            for number, cells in enumerate(rows, 2):
                sheet.write(line(number, cells).encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()
