"""Excel sheets, read on the driver: they are small lookup tables by nature."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read_xlsx(spark: SparkSession, path: str, sheet: int = 0, columns: list[str] | None = None) -> DataFrame:
    """A sheet's rows as text below its first row, which names the columns; unknown wanted columns are ignored."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet + 1}.xml"))
    rows = []
    for r in root.iterfind(".//m:row", _NS):
        row: dict[int, str | None] = {}
        for c in r.iterfind("m:c", _NS):
            v = c.find("m:v", _NS)
            text = v.text if v is not None else "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) or None
            row[_column(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        rows.append(row)
    names = {i: n for i, n in (rows[0] if rows else {}).items() if n and (columns is None or n in columns)}
    return spark.createDataFrame([tuple(r.get(i) for i in names) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names.values()))


def write_xlsx(path: str, rows: list[tuple]) -> None:
    """Writes one sheet of texts (null: no cell), the first row naming the columns; for lookup tables and reports."""
    from xml.sax.saxutils import escape

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    lines = []
    for n, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(row) if v is not None)
        lines.append(f'<row r="{n}">{cells}</row>')
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
