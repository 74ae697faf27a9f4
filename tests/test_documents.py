"""Workbooks read and written, and web pages."""

import io
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from catadrift import Comparison, compare_sheets
from catadrift.__main__ import run
from catadrift.operators import pages
from catadrift.plans import registry
from catadrift.sources import workbooks

HEADERS = ["Database", "Schema", "Tables", "Columns", "Datatype", "IsPII"]
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=(), target="worksheets/{}.xml"):
    """A workbook from the XML of its rows."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="r{i}" Type="x/worksheet" Target="{target.format(i)}"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{x}</si>' for x in shared)}</sst>")


def row(number, *cells):
    inner = "".join(f'<c r="{workbooks._letters(i)}{number}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(cells) if c is not None)
    return f'<row r="{number}">{inner}</row>'


def read(spark, path):
    found = workbooks.workbook_sheets(spark, str(path)).collect()
    return sorted((r.connection, r.row_number, list(r.cells)) for r in found)


def test_cells_of_every_kind(spark, tmp_path):
    shared = ["<t>one</t>", "<r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh><t>no</t></rPh>", "<t>a_x0009_b</t>", "<t/>"]
    rows = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c></row><row r="4"/>'
        '<row r="5"><c r="B5"><v>1.5</v></c><c r="D5" t="b"><v>1</v></c><c r="E5" t="b"><v>0</v></c><c r="F5" t="e"><v>#N/A</v></c><c r="AB5" t="str"><f>x</f><v>y</v></c></row>'
        '<row><c t="s"><v>2</v></c><c t="s"><v>3</v></c><c><v>7</v></c></row>'
    )
    book(tmp_path / "in" / "a.xlsx", {" first ": rows, "empty": "", "second": row(1, "h") + row(2, "&lt;&amp;")}, shared, "/xl/worksheets/{}.xml")
    far = [None, "1.5", None, "True", "False", None, *[None] * 21, "y"]
    assert read(spark, tmp_path / "in") == [(" first ", 5, far), (" first ", 6, ["a\tb", None, "7"]), ("second", 2, ["<&"])]
    heads = workbooks.workbook_headers(spark, str(tmp_path / "in" / "a.xlsx")).collect()
    assert sorted((r.connection, r.pos, r.header) for r in heads) == [(" first ", 0, "one"), (" first ", 1, "rich"), ("second", 0, "h")]


def test_broken_workbook_is_an_error(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        read(spark, tmp_path)


def snapshots(tmp_path):
    prev = row(1, *HEADERS, "Owner") + row(2, "d", "s", "t", "a", "INT", "Yes", "me") + row(3, "d", "s", "t", "gone", "INT", "Yes", "me")
    curr = row(1, "DB_NAME", "schema", "tbl", "field", "dtype", "pii", "Owner") + row(2, "d", "s", "t", "a", "DATE", "Yes", "you") + row(3, "d", "s", "t", "n&lt;w", "INT", "1", None)
    book(tmp_path / "prev.xlsx", {"c": prev, "bad": row(1, *HEADERS) + row(2, *"abcdef"), "old": row(1, *HEADERS)})
    book(tmp_path / "curr.xlsx", {"c ": curr, "bad": row(1, "Schema") + row(2, "x"), "new": row(1, *HEADERS)})
    return str(tmp_path / "prev.xlsx"), str(tmp_path / "curr.xlsx")


def test_comparing_workbooks(spark, tmp_path):
    found = compare_sheets(spark, *snapshots(tmp_path), fmt="xlsx")
    drift = sorted((r.connection, r.column_name, r.change_type, r.severity, r.row_number) for r in found.drift.collect())
    assert drift == [
        ("c", "a", "Datatype Changed", "HIGH", 2), ("c", "gone", "Column Dropped", "HIGH", None), ("c", "n<w", "New Column Added", "HIGH", 3),
    ]
    assert {r.connection: r.status for r in found.connection_status.collect()} == {"c": "ok", "bad": "failed"}
    assert found.run_status.first()["status"] == 3


def test_command_line_reads_workbooks_and_writes_documents(spark, tmp_path):
    assert run([*snapshots(tmp_path), str(tmp_path / "out"), "--format", "xlsx", "--documents"], spark) == 3
    documents = tmp_path / "out" / "documents"
    rows = read(spark, documents / "workbooks")
    assert [r for r in rows if r[0] == "c"] == [
        ("c", 2, ["d", "s", "t", "a", "DATE", "Yes", "you", "Datatype Changed", "HIGH", "Review required"]),
        ("c", 3, ["d", "s", "t", "n<w", "INT", "1", None, "New Column Added", "HIGH", "Add to masking scope immediately"]),
        ("c", 4, ["=== DROPPED ==="]),
        ("c", 5, ["d", "s", "t", "gone", "INT", "Yes", None, "Column Dropped", "HIGH", "Column dropped — PII detected — verify removal — update masking scope"]),
    ]
    page = (documents / "critical" / "connection=c" / "page=1" / "page.html").read_text()
    ElementTree.fromstring(re.sub(r"<!DOCTYPE html>|<meta[^>]*>", "", page))
    assert page.count("<tr style=") == 3 and "n&lt;w" in page
    index = (documents / "pages" / "report=summary" / "index.html").read_text()
    ElementTree.fromstring(re.sub(r"<!DOCTYPE html>|<meta[^>]*>", "", index))
    assert "c: 3 critical changes on 1 pages" in index and "New PII Columns" in index and "Column changes" in index


def test_written_workbooks(spark, tmp_path):
    odd = "tab\t cr\r nl\n us\x1f lit_x0041_ <&>\" é 🙂"
    cells = [[odd, None, ""], ["b", "x", None], ["c", None, "z"], ["d", None, None], ["e", None, None]]
    rows = spark.createDataFrame(
        [("a/b:" + "n" * 40, i, i == 0, "FFFF0000" if i == 1 else None, c) for i, c in enumerate(cells)] + [("z", 0, False, None, ["only"])],
        "connection string, place int, bold boolean, fill string, cells array<string>",
    )
    headers = spark.createDataFrame([("a/b:" + "n" * 40, ["h1", "h2", "h3"]), ("z", ["h"])], "connection string, cells array<string>")
    books = workbooks.workbooks(rows, headers, ["place"], rows_per_sheet=2)
    workbooks.write_workbooks(books, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").rglob("*.xlsx"))
    assert len(files) == 4 and all(f.name == "sheet.xlsx" for f in files)
    for f in files:
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            for name in z.namelist():
                ElementTree.fromstring(z.read(name))
    name = "a_b_" + "n" * 27
    got = {tuple(x[2]) for x in read(spark, tmp_path / "out") if x[0] == name}
    assert got == {(odd, None, None), ("b", "x"), ("c", None, "z"), ("d",), ("e",)}
    first = next(b for b in books.collect() if b.connection != "z" and b.part == 0)
    with zipfile.ZipFile(io.BytesIO(bytes(first.content) + b"\n")) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "FFFF0000" in z.read("xl/styles.xml").decode()
    assert 's="2"' in sheet and sheet.count('s="1"') == 3 + 2  # the header, and a bold row of two cells


def test_nothing_to_write(spark, tmp_path):
    schema = "connection string, db_name string, schema_name string, table_name string, column_name string, datatype string, is_pii_raw string, row_number long"
    none = spark.createDataFrame([], schema)
    found = Comparison(none, none)
    found.write_documents(str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.xlsx"))
    assert pages.NO_CRITICAL in (tmp_path / "out" / "pages" / "report=summary" / "index.html").read_text()


def test_pages_of_bounded_length(spark):
    rows = [("c", "d", "s", "t", f"x{i:03}", "Yes", "New Column Added", "HIGH", 'say "hi"', "#ffe0e0") for i in range(25)] + [("e", "d", "s", "t", "y", "Yes", "Column Dropped", "HIGH", None, "#fff")]
    names = "connection db_name schema_name table_name column_name is_pii change_type severity action tint".split()
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {(r.connection, r.page): (r.n_rows, r.html) for r in pages.critical_pages(table, rows_per_page=10).collect()}
    assert {k: n for k, (n, _) in got.items()} == {("c", 1): 10, ("c", 2): 10, ("c", 3): 5, ("e", 1): 1}
    order = [x for p in (1, 2, 3) for x in re.findall(r"<td>(x\d+)</td>", got["c", p][1])]
    assert order == [f"x{i:03}" for i in range(25)] and "say &quot;hi&quot;" in got["c", 1][1]
    assert pages.critical_pages(table.where(F.lit(False))).count() == 0


def test_written_workbooks_are_read_without_the_xml_parser(monkeypatch):
    """Other forms are left to the parser, from where they begin."""
    rows = [(2, False, None, [" a & <b>", "_x0041_", None, "l\r\n\tm", 'q"é']), (4, True, "FF00FF00", [None, "\x01", "", "]]>"])]
    part = "xl/worksheets/sheet1.xml"
    book = zipfile.ZipFile(io.BytesIO(workbooks.workbook("c", iter(rows), ["FF00FF00"]) + b"\n"))
    expected = [(2, [" a & <b>", "_x0041_", None, "l\r\n\tm", 'q"é']), (4, [None, "\x01", None, "]]>"])]
    assert list(workbooks._parsed_rows(book, part, [])) == expected
    row = '<row r="{}"><c r="A{}" t="{}">{}</c></row>'
    forms = [("inlineStr", "<is><r><t>a</t></r><rPh><t>b</t></rPh></is>"), ("s", "<v>1</v>"), ("b", "<v>1</v>"), ("e", "<v>#N/A</v>"), ("str", "<f>1&lt;2</f><v>x&#10;</v>"), ("n", "<v>1.50</v>")]
    for i in range(len(forms)):
        mixed = forms[i:] + forms[:i]
        text = f'<worksheet xmlns="{workbooks.MAIN}"><sheetData>' + "".join(row.format(n, n, *f) for n, f in enumerate(mixed, 1)) + "</sheetData></worksheet>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as made:
            made.writestr(part, text)
        assert list(workbooks._rows(zipfile.ZipFile(out), part, ["x", "_y"])) == list(workbooks._parsed_rows(zipfile.ZipFile(out), part, ["x", "_y"]))
    monkeypatch.setattr(workbooks, "_parsed_rows", None)
    assert list(workbooks._rows(book, part, [])) == expected


def test_workbooks_compute_the_comparison_once(spark):
    books = registry.comparison(spark, "/root/testdata/sf0.001").materialise().workbooks
    assert "FileScan" not in books._jdf.queryExecution().executedPlan().toString()


def test_ends_of_a_sheet_are_found_without_cutting_the_rest(monkeypatch):
    rows = [(n, False, None, [f"a{n}", None, "c" * 90]) for n in range(2, 20_002)]
    part, cut = "xl/worksheets/sheet1.xml", []
    lot = workbooks._lot
    monkeypatch.setattr(workbooks, "_lot", lambda content, shared: cut.append(len(content)) or lot(content, shared))
    book = zipfile.ZipFile(io.BytesIO(workbooks.workbook("c", iter(rows), []) + b"\n"))
    assert workbooks._ends(book, part, []) == [2, 20_001]
    assert sum(cut) < book.getinfo(part).file_size / 10
    few = [(5, False, None, [None]), (7, False, None, ["x"]), *[(n, False, None, [None, ""]) for n in range(8, 9_000)]]
    book = zipfile.ZipFile(io.BytesIO(workbooks.workbook("c", iter(few), []) + b"\n"))
    assert workbooks._ends(book, part, []) == [7, 7]
    assert list(workbooks._rows(book, part, [])) == [(7, ["x"])]


def test_all_rows_of_a_piece_are_cut_at_once(monkeypatch):
    """Kinds, escapes, columns left out or out of order, empty cells and rows, as the parser has them."""
    one = '<c r="{}" s="3" t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'
    rows = [
        one.format("A1", "x &amp; y") + '<c r="C1"><v>1.5</v></c>' + '<c r="AB1" s="2"/>', "", '<c r="B3" t="s"><v>1</v></c><c r="A3" t="b"><v>1</v></c>',
        one.format("A4", "a_x0009_b") + '<c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="str"><v>c_x0009_</v></c><c r="D4" t="s"><v>2</v></c>',
        '<c r="A5"/>', '<c r="A6" t="inlineStr"><is><t>é&gt;</t></is></c><c r="B6" t="b"><v>0</v></c><c r="C6" t="inlineStr"><v>no</v></c>', one.format("A7", "1") + one.format("A7", "2"),
    ]
    text = f'<worksheet xmlns="{workbooks.MAIN}"><sheetData>' + "\n".join(f'<row r="{n}" spans="1:3">{x}</row>' for n, x in enumerate(rows, 1)) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        made.writestr("s.xml", text)
    shared = ["zero", "on_x0009_e", ""]
    expected = list(workbooks._parsed_rows(zipfile.ZipFile(out), "s.xml", shared))
    assert [n for n, _ in expected] == [1, 3, 4, 6, 7] and expected[1] == (3, ["True", "on_x0009_e"])
    monkeypatch.setattr(workbooks, "_parsed_rows", None)
    assert list(workbooks._rows(zipfile.ZipFile(out), "s.xml", shared)) == expected
    numbers, cells = next(workbooks._lots(zipfile.ZipFile(out), "s.xml", shared))
    assert len(numbers) == len(cells) == 5
