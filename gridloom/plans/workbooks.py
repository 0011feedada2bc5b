"""A minimal workbook writer, so that scans can be tried on workbooks made from the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from datetime import date
from xml.sax.saxutils import escape, quoteattr

_TYPES = "http://schemas.openxmlformats.org"


def _ref(column: int, row: int) -> str:
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def _cell(value, column: int, row: int) -> str:
    at = _ref(column, row)
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, date):
        return f'<c r="{at}" s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def workbook(sheets: Mapping[str, Sequence[Sequence]]) -> bytes:
    """Bytes of an .xlsx with the given sheets; an empty row is left out of the file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_TYPES}/spreadsheetml/2006/main" xmlns:r="{_TYPES}/officeDocument/2006/relationships"><sheets>'
            + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
            + "</sheets></workbook>",
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{_TYPES}/package/2006/relationships">'
            + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="x"/>' for i in range(1, len(sheets) + 1))
            + "</Relationships>",
        )
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{_TYPES}/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, rows in enumerate(sheets.values(), 1):
            width = max((len(r) for r in rows), default=0)
            body = "".join(
                f'<row r="{n}">' + "".join(_cell(v, c, n) for c, v in enumerate(r, 1)) + "</row>" for n, r in enumerate(rows, 1) if r
            )
            size = f'<dimension ref="A1:{_ref(max(width, 1), max(len(rows), 1))}"/>'
            z.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{_TYPES}/spreadsheetml/2006/main">{size}<sheetData>{body}</sheetData></worksheet>',
            )
    return out.getvalue()
