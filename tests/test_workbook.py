"""Workbooks written here as literal XML, not by the library's own writer."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.sources.workbook import _Book, failed_files, good_rows, read_workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org"
STYLES = f"""<?xml version="1.0"?><styleSheet {MAIN}>
<numFmts count="3"><numFmt numFmtId="164" formatCode="[$-416]d \\de mmmm;@"/><numFmt numFmtId="165" formatCode="0.00 &quot;dias&quot;"/>
<numFmt numFmtId="166" formatCode="[Red]0.0"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="21"/></cellXfs></styleSheet>"""
STRINGS = f"""<sst {MAIN}><si><t>first</t></si><si><r><rPr><b/></rPr><t>rich </t></r><r><t>text</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si>
<si><t xml:space="preserve"> kept </t></si><si><t/></si></sst>"""


def book(path, sheets, styles=STYLES, strings=STRINGS, properties="", absolute=False):
    """sheets: name -> XML inside worksheet."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}/officeDocument/2006/relationships">{properties}<sheets>{names}</sheets></workbook>')
        target = "/xl/worksheets/s{}.xml" if absolute else "worksheets/s{}.xml"
        links = "".join(f'<Relationship Id="r{i}" Target="{target.format(i)}" Type="t"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{REL}/package/2006/relationships">{links}</Relationships>')
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}>{body}</worksheet>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        if strings:
            z.writestr("xl/sharedStrings.xml", strings)


def scanned(spark, folder, **more):
    found = spark.read.format("binaryFile").load(folder).select("path").withColumn("file_id", F.regexp_extract("path", r"(\d+)\.[a-zA-Z]+$", 1).cast("bigint"))
    return read_workbooks(spark, folder, found, **more)


def cells(rows, sheet):
    return [[(c.kind, c.num, c.txt) for c in r["cells"]] for r in sorted((r for r in rows if r.sheet == sheet), key=lambda r: r.row_no)]


CASES = [
    ('<c r="A1" t="s"><v>0</v></c>', ("text", None, "first")),
    ('<c r="A1" t="s"><v>1</v></c>', ("text", None, "rich text")),
    ('<c r="A1" t="s"><v>2</v></c>', ("text", None, " kept ")),
    ('<c r="A1" t="s"><v>3</v></c>', ("text", None, "")),
    ('<c r="A1" t="inlineStr"><is><t>in &amp; line</t></is></c>', ("text", None, "in & line")),
    ('<c r="A1" t="str"><f>A2&amp;"x"</f><v>made x</v></c>', ("text", None, "made x")),
    ('<c r="A1"><f>1+2</f><v>3</v></c>', ("number", 3.0, "3")),
    ('<c r="A1"><f>1+2</f></c>', ("blank", None, "")),
    ('<c r="A1" t="e"><v>#DIV/0!</v></c>', ("text", None, "#DIV/0!")),
    ('<c r="A1" t="b"><v>1</v></c>', ("bool", 1.0, "True")),
    ('<c r="A1"><v>1.5E3</v></c>', ("number", 1500.0, "1500.0")),
    ('<c r="A1" s="1"><v>45292</v></c>', ("date", None, "2024-01-01")),
    ('<c r="A1" s="2"><v>45292.75</v></c>', ("date", None, "2024-01-01")),
    ('<c r="A1" s="3"><v>7</v></c>', ("number", 7.0, "7")),  # "dias" is quoted text, not a day
    ('<c r="A1" s="4"><v>7</v></c>', ("number", 7.0, "7")),  # a colour, not a date
    ('<c r="A1" s="5"><v>0.5</v></c>', ("text", None, "12:00:00")),
    ('<c r="A1" t="d"><v>2024-02-29T10:00:00</v></c>', ("date", None, "2024-02-29")),
    ('<c r="A1" s="1"><v>59</v></c>', ("date", None, "1900-02-28")),
]


@pytest.mark.parametrize("xml, want", CASES)
def test_cell_types(tmp_path, xml, want):
    book(tmp_path / "1.xlsx", {"S": f'<sheetData><row r="1">{xml}</row></sheetData>'})
    with open(tmp_path / "1.xlsx", "rb") as f:
        read = _Book(f)
        assert [[(c["kind"], c["num"], c["txt"]) for c in row] for row in read.rows(read.sheets[0][1])] == [[want]]


def test_epoch_gaps_and_sizes(spark, tmp_path):
    """1904 dates, absolute targets, rows and cells left out, a declared size that is too small or too large, no styles, no texts."""
    body = '<dimension ref="A1:C4"/><sheetData><row r="2"><c r="B2"><v>1</v></c></row><row r="4"><c r="A4"><v>2</v></c><c r="E4"><v>3</v></c></row></sheetData>'
    book(tmp_path / "1.xlsx", {"gaps": body}, styles=None, strings=None)
    book(tmp_path / "2.XLSX", {"old": '<sheetData><row><c s="1"><v>0</v></c><c s="1"><v>366</v></c></row></sheetData>'}, properties='<workbookPr date1904="1"/>', absolute=True)
    rows = scanned(spark, str(tmp_path)).collect()
    blank, n = ("blank", None, ""), lambda x: ("number", float(x), str(x))
    assert cells(rows, "gaps") == [[blank] * 3, [blank, n(1), blank], [blank] * 3, [n(2), blank, blank, blank, n(3)]]
    assert [c[2] for c in cells(rows, "old")[0]] == ["00:00:00", "1905-01-01"]


def test_sheets_of_a_book_in_several_tasks(spark, tmp_path):
    sheets = {f"s{i}": f'<sheetData><row r="1"><c r="A1"><v>{i}</v></c></row></sheetData>' for i in range(16)}
    book(tmp_path / "1.xlsx", sheets)
    scan = scanned(spark, str(tmp_path))
    at = scan.select("sheet", F.spark_partition_id().alias("p")).collect()
    assert len({r.sheet for r in at}) == 16 and len({r.p for r in at}) > 4
    one = scanned(spark, str(tmp_path), direct=False).drop("error")
    assert sorted(map(str, one.collect())) == sorted(map(str, scan.drop("error").collect()))


def test_only_used_texts_are_kept(tmp_path):
    """A sheet of a book with 50,000 shared texts keeps its three."""
    strings = f"<sst {MAIN}>" + "".join(f"<si><t>{i}</t></si>" for i in range(50_000)) + "</sst>"
    use = lambda ks: "<sheetData><row>" + "".join(f'<c t="s"><v>{k}</v></c>' for k in ks) + "</row></sheetData>"
    book(tmp_path / "1.xlsx", {"few": use([7, 49_999, 7, 0]), "all": use(range(50_000))}, strings=strings)
    with open(tmp_path / "1.xlsx", "rb") as f:
        read = _Book(f)
        assert [c["txt"] for row in read.rows(read.sheets[0][1]) for c in row] == ["7", "49999", "7", "0"]
        assert read.strings == {0: "0", 7: "7", 49_999: "49999"}
        assert [c["txt"] for row in read.rows(read.sheets[1][1]) for c in row] == [str(i) for i in range(50_000)]


def test_broken_sheets_and_books(spark, tmp_path):
    """A broken sheet makes its file an error, once; other files stay; binary workbooks are errors."""
    good = '<sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData>'
    broken = '<sheetData><row r="1"><c r="A1"><v>5</v></c></row><row'
    (tmp_path / "a b#%20").mkdir()
    book(tmp_path / "a b#%20" / "1.xlsm", {"S": good})
    book(tmp_path / "2.xlsx", {"S": good, "T": broken, "U": broken})
    book(tmp_path / "3.xlsx", {"S": '<sheetData><row r="1"><c r="A1" t="s"><v>99</v></c></row></sheetData>'})
    (tmp_path / "4.xlsx").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "5.xlsb", "w") as z:
        z.writestr("xl/workbook.bin", b"")
    book(tmp_path / "6.xlsx", {})
    found = spark.createDataFrame([(i, f"file:{tmp_path}/{n}") for i, n in [(1, "a b#%20/1.xlsm"), (2, "2.xlsx"), (3, "3.xlsx"), (4, "4.xlsx"), (5, "5.xlsb"), (6, "6.xlsx")]], "file_id int, path string")
    scan = read_workbooks(spark, str(tmp_path), found).cache()
    assert [(r.file_id, r.sheet) for r in good_rows(scan).collect()] == [(1, "S")]
    failed = {r.file_id: r.error for r in failed_files(scan).collect()}
    assert sorted(failed) == [2, 3, 4, 5] and failed_files(scan).count() == 4 and "xlsb" in failed[5]
