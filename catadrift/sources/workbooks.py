"""Snapshots in workbooks (.xlsx): reading them sheet by sheet, and writing reports as workbooks.

A workbook is one file, so a task parses it whole, row by row; each of its sheets is a connection. Values are taken as text:
numbers as they are stored, booleans as True and False, error values as null, formulas by their last result. The first
row that holds anything is the header; rows without any cell are skipped, and row numbers are those of the sheet.

Written are workbooks of one sheet each. A connection with more rows than a sheet may hold becomes several workbooks, so a
task never holds more than one sheet. Sheet names follow the format's rules: at most 31 characters, without []:*?/\\.
"""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catadrift.plans.session import join_facts
from catadrift.sources.positions import placed_rows
from catadrift.sources.sheets import BATCH, RECORDS, numbered, records_batch
from catadrift.sources.sinks import write_files

#: Rows of a sheet below its header; the format allows 1,048,575.
ROWS_PER_SHEET = 250_000
EXTENSION = "*.xlsx"
#: Bytes of a sheet's text at a time.
CHUNK = 1 << 20
#: The same of a sheet's beginning.
FIRST = 1 << 16
#: Rows of a sheet written at a time.
LOT = 2_000
# Fixed values of the file format.
RELATIONSHIP = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
ENCODED = re.compile("_x([0-9A-Fa-f]{4})_")
#: What has to be escaped, as Arrow writes it.
MARKUP = r"[&<>\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]|_x"
NOT_XML = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


# Reading.


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _decoded(text: str) -> str:
    return ENCODED.sub(lambda m: chr(int(m[1], 16)), text)


def _rich_text(element: ElementTree.Element) -> str:
    """A plain text, or the runs of a rich one without their phonetic readings."""
    own = [child if _local(child) == "t" else next((x for x in child if _local(x) == "t"), None) for child in element if _local(child) in ("t", "r")]
    return _decoded("".join(x.text or "" for x in own if x is not None))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of every worksheet, in the workbook's order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    parts = {x.get("Id"): posixpath.normpath(posixpath.join("/xl", x.get("Target"))).lstrip("/") for x in links if x.get("Type", "").endswith("/worksheet")}
    found = []
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(x) == "sheet":
            part = next((parts[v] for k, v in x.attrib.items() if k.rpartition("}")[2] == "id" and v in parts), None)
            if part:
                found.append((x.get("name"), part))
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as stream:
        found = []
        for _, x in ElementTree.iterparse(stream):
            if _local(x) == "si":
                found.append(_rich_text(x))
                x.clear()
        return found


def _column(reference: str) -> int:
    """The place of a cell such as AB7, counted from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    inner = {_local(x): x for x in cell}
    if kind == "inlineStr":
        return _rich_text(inner["is"]) if "is" in inner else None
    text = inner["v"].text if "v" in inner else None
    if text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "True" if text.strip() == "1" else "False"
    return _decoded(text)


def _parsed_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of every row that holds anything, of a sheet in any XML."""
    number = 0
    with book.open(part) as stream:
        body = None
        for event, x in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start" and _local(x) == "sheetData":
                body = x
            elif event == "end" and _local(x) == "row":
                number = int(x.get("r", number + 1))
                cells: list[str | None] = []
                for cell in x:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, shared) or None
                if any(c is not None for c in cells):
                    yield number, cells
                if body is not None:
                    body.clear()


class _OtherForm(Exception):
    """A sheet is not in the form that rows are cut from as text."""


#: The form that usual programs write; all else, such as prefixes, formulas, rich text or comments, is left to the XML parser.
SHEET_TAG, SHEET_END, ROW_END = b"<sheetData>", b"</sheetData>", b"</row>"
ROW = re.compile(rb'<row r="([0-9]+)"(?: [a-zA-Z0-9:]+="[^"<&]*")*>')
#: The tag of a cell, its numbers written as #, as far as the text or value that it holds.
CELL = re.compile(r'<c r="([A-Z]+)#"(?: s="#")?(?: t="([a-zA-Z]+)")?(/>)?')
#: Signs that stand for tags around a text, a value and after a row; texts can't hold them.
TEXT, VALUE, TEXT_END, VALUE_END, END = range(1, 6)
SIGNS = [
    (b' t="inlineStr"><is><t xml:space="preserve">', TEXT), (b' t="inlineStr"><is><t>', TEXT), (b"</t></is></c>", TEXT_END), (b"><v>", VALUE),
    (b"</v></c>", VALUE_END), (ROW_END, END),
]
#: The other tags by number, and what may follow each tag.
IN_ROW, IN_CELL, EMPTY_CELL = 6, 7, 0
_NEXT = (IN_CELL, EMPTY_CELL, END)
_AFTER = {
    IN_ROW: _NEXT, IN_CELL: (TEXT, VALUE), EMPTY_CELL: _NEXT, TEXT: (TEXT_END,), VALUE: (VALUE_END,), TEXT_END: _NEXT, VALUE_END: _NEXT, END: (IN_ROW,),
}
FOLLOWS = np.array([y in _AFTER[x] for x in range(8) for y in range(8)])
CONTROLS = bytes(i for i in range(32) if i not in (9, 10))
NOT_TEXT = (b"]]>", "\ufffe".encode(), "\uffff".encode())
ENTITY = re.compile("&([^;]*);?")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Numbers of rows, and their cells.
Lot = tuple[np.ndarray, pa.ListArray]


def _entity(found: re.Match) -> str:
    if found[1] not in ENTITIES or not found[0].endswith(";"):
        raise _OtherForm
    return ENTITIES[found[1]]


def _pieces(stream: IO[bytes], first: int = CHUNK) -> Iterator[bytes]:
    """The text of whole rows, some at a time; the XML around them must be well-formed."""
    head, size = b"", first
    while SHEET_TAG not in head:
        more = stream.read(size)
        if not more or len(head) > CHUNK:
            raise _OtherForm
        head += more
    head, _, rest = head.partition(SHEET_TAG)
    declared = re.search(rb"encoding=[\"']([^\"']*)", head)
    if b"<!" in head or b"row" in head or (declared and declared[1].lower() != b"utf-8"):
        raise _OtherForm
    more = True
    while SHEET_END not in rest and more:
        end = rest.rfind(ROW_END) + len(ROW_END)
        if end >= len(ROW_END):
            yield rest[:end]
            rest, size = rest[end:], CHUNK
        more = stream.read(size)
        rest += more
    rows, end, tail = rest.partition(SHEET_END)
    tail += stream.read()
    if not end or b"row" in tail or b"<!" in tail:
        raise _OtherForm
    last = rows.rfind(ROW_END) + len(ROW_END)
    if rows[last if last >= len(ROW_END) else 0:].strip():
        raise _OtherForm
    if last >= len(ROW_END):
        yield rows[:last]
    ElementTree.fromstring(head + SHEET_TAG + SHEET_END + tail)


def _signed(content: bytes) -> bytes:
    """The text of rows, with a sign for every tag around a text or value."""
    if len(content.translate(None, CONTROLS)) < len(content):
        raise _OtherForm
    for tags, sign in SIGNS:
        content = content.replace(tags, bytes([sign]))
    if any(x in content for x in NOT_TEXT):
        raise _OtherForm
    try:
        content.isascii() or content.decode("utf-8")
    except UnicodeDecodeError:
        raise _OtherForm from None
    return content


def _each(texts: pa.Array, chosen: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The texts, the chosen ones changed; equal ones are changed once."""
    chosen = pc.fill_null(chosen, False)
    if not pc.any(chosen).as_py():
        return texts
    found = texts.filter(chosen).dictionary_encode()
    return pc.replace_with_mask(texts, chosen, pa.array([change(x) for x in found.dictionary.to_pylist()], pa.string()).take(found.indices))


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str | None, bool]]]:
    """Column, kind and emptiness of the forms that tags of cells have, and the form of each."""
    size = ends - starts
    edges = np.append(0, np.cumsum(size))
    tags = data[np.repeat(starts - edges[:-1], size) + np.arange(edges[-1])]
    digit = (tags >= ord("0")) & (tags <= ord("9"))
    tags[digit] = ord("#")
    kept = np.ones(len(tags), bool)
    kept[1:] = ~(digit[1:] & digit[:-1])
    edges = np.append(0, np.cumsum(kept))[edges].astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(tags[kept])).dictionary_encode()
    forms = [CELL.fullmatch(x) for x in found.dictionary.to_pylist()]
    if None in forms:
        raise _OtherForm
    return found.indices.to_numpy(), [(_column(x[1]), x[2], bool(x[3])) for x in forms]


def _lot(content: bytes, shared: pa.Array) -> Lot:
    """Rows from their text: its tags must be those of the usual form, each after one that it may follow."""
    content = _signed(content)
    data = np.frombuffer(content, np.uint8)
    opens = np.flatnonzero((data <= END) | (data == ord("<")))
    ends = np.append(opens[1:], len(data))
    if content[: opens[0]].strip():
        raise _OtherForm
    code = data[opens].astype(np.int64)
    tags = np.flatnonzero(code == ord("<"))
    name = data[opens[tags] + 1]
    if not ((name == ord("r")) | (name == ord("c"))).all():
        raise _OtherForm
    is_row, is_cell = np.zeros(len(code), bool), np.zeros(len(code), bool)
    is_row[tags[name == ord("r")]] = is_cell[tags[name == ord("c")]] = True
    code[is_row] = IN_ROW
    rows = [ROW.fullmatch(content, x, y) for x, y in zip(opens[is_row].tolist(), ends[is_row].tolist())]
    if None in rows:
        raise _OtherForm
    form, forms = _forms(data, opens[is_cell], ends[is_cell])
    empty = np.array([x[2] for x in forms], bool)[form]
    code[is_cell] = np.where(empty, EMPTY_CELL, IN_CELL)
    if code[0] != IN_ROW or code[-1] != END or not FOLLOWS[code[:-1] * 8 + code[1:]].all():
        raise _OtherForm
    after = np.flatnonzero((code >= TEXT_END) & (code <= END) & (ends - opens > 1))
    if any(code[i] != END or content[opens[i] + 1:ends[i]].strip() for i in after.tolist()):
        raise _OtherForm
    # a cell that isn't empty holds one text; texts and what lies between them, in turn
    holds = (code == TEXT) | (code == VALUE)
    n = np.count_nonzero(holds)
    edges = np.empty(2 * n + 1, np.int32)
    edges[:-1:2], edges[1::2], edges[-1] = opens[holds] + 1, ends[holds], len(data)
    parts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(edges), pa.py_buffer(content))
    at = np.full(len(form), -1, np.int64)
    at[~empty] = 2 * np.arange(n)
    inline = np.zeros(len(form), bool)
    inline[~empty] = code[holds] == TEXT
    if any(x[1] and (form[inline] == i).any() for i, x in enumerate(forms)):
        raise _OtherForm
    texts = _values(parts, at, inline, [x[1] for x in forms], form, content, shared)
    width = np.diff(np.append(np.cumsum(is_cell)[is_row], len(form)))
    row = np.repeat(np.arange(len(rows)), width)
    place = np.array([x[0] for x in forms], np.int64)[form] if forms else np.zeros(0, np.int64)
    starts = np.append(0, np.cumsum(width))
    if (place != np.arange(len(form)) - starts[row]).any():
        width = np.zeros(len(rows), np.int64)
        np.maximum.at(width, row, place + 1)
        starts = np.append(0, np.cumsum(width))
        source = np.full(starts[-1], -1, np.int64)
        source[starts[row] + place] = np.arange(len(form))
        texts = texts.take(pa.array(source, mask=source < 0))
    cells = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts)
    filled = np.add.reduceat(np.append(texts.is_valid().to_numpy(zero_copy_only=False), False).astype(np.int64), starts[:-1]) * (width > 0) > 0
    numbers = np.array([int(x[1]) for x in rows], np.int64)
    return (numbers, cells) if filled.all() else (numbers[filled], cells.filter(pa.array(filled)))


def _values(parts: pa.Array, at: np.ndarray, inline: np.ndarray, kinds: list[str | None], form: np.ndarray, content: bytes, shared: pa.Array) -> pa.Array:
    """Values of cells, whose texts are at the given places."""
    of = {k: np.isin(form, [i for i, x in enumerate(kinds) if x == k]) & ~inline for k in set(kinds) - {None}}
    none = (at < 0) | of.get("inlineStr", False) | of.get("e", False)
    texts = parts.take(pa.array(at, mask=none))
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.string()), texts)
    if b"&" in content:
        texts = _each(texts, pc.match_substring(texts, "&"), lambda x: ENTITY.sub(_entity, x))
    is_shared, is_flag = (pa.array(of.get(k, np.zeros(len(form), bool))) for k in "sb")
    if b"_x" in content:
        texts = _each(texts, pc.and_(pc.match_substring(texts, "_x"), pc.invert(is_shared)), _decoded)
    if "b" in of:
        texts = _each(texts, pc.and_(is_flag, texts.is_valid()), lambda x: "True" if x.strip() == "1" else "False")
    if "s" in of:
        chosen = pc.and_(is_shared, texts.is_valid())
        places = pa.array([int(x) for x in texts.filter(chosen).to_pylist()], pa.int64())
        texts = pc.replace_with_mask(texts, chosen, shared.take(places))
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.string()), texts)
    return texts


def _lists(rows: Iterable[tuple[int, list[str | None]]]) -> Iterator[Lot]:
    rows = iter(rows)
    while held := list(itertools.islice(rows, BATCH)):
        yield np.array([x for x, _ in held], np.int64), pa.array([x for _, x in held], pa.list_(pa.string()))


def _lots(book: zipfile.ZipFile, part: str, shared: list[str], first: int = CHUNK) -> Iterator[Lot]:
    """Numbers and cells of the rows that hold anything, some at a time.

    Rows in the usual form are cut from the text, all of a piece at once, which takes a small part of an XML parser's time.
    From the first piece that has another form, the parser reads on.
    """
    done, strings = 0, pa.array(shared, pa.string())
    try:
        with book.open(part) as stream:
            for piece in _pieces(stream, first):
                numbers, cells = _lot(piece, strings)
                if len(numbers):
                    yield numbers, cells
                    done += len(numbers)
    except _OtherForm:
        yield from _lists(itertools.islice(_parsed_rows(book, part, shared), done, None))


def _rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of every row that holds anything."""
    for numbers, cells in _lots(book, part, shared):
        yield from zip(numbers.tolist(), cells.to_pylist(), strict=True)


def _ends(book: zipfile.ZipFile, part: str, shared: list[str]) -> list[int]:
    """Numbers of the first row that holds anything and of the last one. In the usual form, only pieces at the ends are cut."""
    strings, found, last = pa.array(shared, pa.string()), [], b""
    try:
        with book.open(part) as stream:
            for piece in _pieces(stream, FIRST):
                if b"<!" in piece:
                    raise _OtherForm
                if found:
                    last = piece[piece.rfind(ROW_END, 0, -min(len(piece), FIRST)) + len(ROW_END):] if len(piece) > FIRST else piece
                else:
                    found = _lot(piece, strings)[0].tolist()
        if last:
            found += _lot(last, strings)[0].tolist() or [x for numbers, _ in _lots(book, part, shared) for x in numbers.tolist()]
    except _OtherForm:
        found = [x for x, _ in _rows(book, part, shared)]
    return [found[0], found[-1]] if found else []


#: What is taken of a sheet.
HEADER, ROWS, LAST = "header", "rows", "last"


def _records(book: zipfile.ZipFile, part: str, shared: list[str], taken: str) -> Iterator[Lot]:
    """Indexes, the header's being 0, and cells of what is taken of a sheet."""
    if taken == LAST:
        ends = _ends(book, part, shared)
        if ends:
            yield np.array([0 if ends[0] == ends[1] else ends[1] - 1]), pa.array([[]], pa.list_(pa.string()))
        return
    first = True
    for numbers, cells in _lots(book, part, shared, FIRST if taken == HEADER else CHUNK):
        index = numbers - 1
        if first:
            index[0], first = 0, False
        if taken == HEADER:
            yield index[:1], cells[:1]
            return
        yield index, cells


def _parse(taken: str):
    """Records of sheets: the header, all rows, or only the last row, without its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                file = file.as_py()
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as book:
                    shared = _shared_strings(book)
                    for place, (name, part) in enumerate(_sheets(book)):
                        sheet = f"{file}#{place}"
                        for index, cells in _records(book, part, shared, taken):
                            yield records_batch(name, sheet, index, cells)

    return run


def _records_of(spark: SparkSession, path: str, taken: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", EXTENSION).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_parse(taken), RECORDS)


def workbook_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all sheets: connection, file, pos, header (null if blank). Only the first row of a sheet is parsed."""
    return _records_of(spark, path, HEADER).select("connection", "file", F.posexplode("cells").alias("pos", "header"))


def workbook_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets: connection, file, row_number, cells."""
    return numbered(_records_of(spark, path, ROWS), _records_of(spark, path, LAST))


# Writing.


def _escaped(text: str) -> str:
    return escape(NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


@cache
def _letters(place: int) -> str:
    """The name of a column, counted from 0."""
    out, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def _styles(fills: list[str]) -> str:
    """Styles 0 (plain), 1 (bold), and one from 2 on for each fill."""
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{x}"/></patternFill></fill>' for x in fills)
    used = "".join(f'<xf numFmtId="0" fontId="0" fillId="{i}" borderId="0" applyFill="1"/>' for i in range(2, len(fills) + 2))
    return (
        f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(fills) + 2}">'
        f'<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="{len(fills) + 2}"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>'
        f'<xf numFmtId="0" fontId="1" fillId="0" borderId="0" applyFont="1"/>{used}</cellXfs></styleSheet>'
    )


def sheet_name(connection: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", connection)[:31] or "_"


def _rows_xml(number: pa.Array, style: list[int], cells: pa.ListArray) -> memoryview:
    """The text of some rows, each with the place of its style."""
    n = len(number)
    if not n:
        return memoryview(b"")
    width = pc.fill_null(pc.list_value_length(cells), 0).to_numpy()
    row = np.repeat(np.arange(n), width)
    place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    texts = cells.flatten()
    filled = texts.is_valid()
    kept = filled.to_numpy(zero_copy_only=False)
    texts, row, place = texts.filter(filled), row[kept], place[kept]
    texts = _each(texts, pc.match_substring_regex(texts, MARKUP), _escaped)
    number = number.cast(pa.string())
    names = pa.array([f'<c r="{_letters(i)}' for i in range(max(width, default=0))], pa.string())
    styles = pa.array([f'" s="{x}" t="inlineStr"><is><t xml:space="preserve">' for x in range(max(style) + 1)], pa.string())
    at, end = pa.array(row), pa.scalar("</t></is></c>")
    filled = pc.binary_join_element_wise(names.take(pa.array(place)), number.take(at), styles.take(pa.array(np.array(style)[row])), texts, end, "")
    edges = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
    inner = pc.binary_join(pa.ListArray.from_arrays(edges, filled), "")
    lines = pc.binary_join_element_wise('<row r="', number, '">', inner, "</row>", "")
    return memoryview(lines.buffers()[2])[: np.frombuffer(lines.buffers()[1], np.int32, n + 1)[n]]


ROW_SCHEMA = pa.schema([("number", pa.int64()), ("bold", pa.bool_()), ("fill", pa.string()), ("cells", pa.list_(pa.string()))])


def workbook(connection: str, rows: Iterable[tuple[int, bool, str | None, list]], fills: list[str]) -> bytes:
    """A workbook of one sheet: rows of (number, bold, fill, cells) by number."""
    lots = iter(lambda it=iter(rows): list(itertools.islice(it, LOT)), [])
    return _workbook(connection, (pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lot), ROW_SCHEMA)], schema=ROW_SCHEMA) for lot in lots), fills)


def _workbook(connection: str, lots: Iterable[pa.RecordBatch], fills: list[str]) -> bytes:
    style = {x: i for i, x in enumerate(fills, 2)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        kinds = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet", "xl/styles.xml": "styles"}
        named = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds.items())
        rels = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types">{rels}{named}</Types>')
        link = '<Relationship Id="{}" Type="' + RELATIONSHIP + '/{}" Target="{}"/>'
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{link.format("r1", "officeDocument", "xl/workbook.xml")}</Relationships>')
        parts = link.format("r1", "worksheet", "worksheets/sheet1.xml") + link.format("r2", "styles", "styles.xml")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{parts}</Relationships>')
        name = quoteattr(NOT_XML.sub("_", sheet_name(connection)))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONSHIP}"><sheets><sheet name={name} sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/styles.xml", _styles(fills))
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for lot in lots:
                styles = [style.get(fill, 1 if bold else 0) for bold, fill in zip(lot["bold"].to_pylist(), lot["fill"].to_pylist(), strict=True)]
                sheet.write(_rows_xml(lot["number"], styles, lot["cells"]))
            sheet.write(b"</sheetData></worksheet>")
        # the text sink ends a value with a line break, which thus is the archive's comment
        book.comment = b"\n"
    return out.getvalue()[:-1]


def _books(table: pa.Table) -> pa.Table:
    table = table.sort_by("number")
    fills = sorted({x for x in table["fill"].unique().to_pylist() if x})
    lots = table.select(["number", "bold", "fill", "cells"]).to_batches(max_chunksize=LOT)
    connection = table["connection"][0].as_py()
    return pa.table({"connection": [connection], "part": pa.array([table["part"][0].as_py()], pa.int64()), "content": pa.array([_workbook(connection, lots, fills)], pa.binary())})


def workbooks(rows: DataFrame, headers: DataFrame, order: list[str], rows_per_sheet: int = ROWS_PER_SHEET) -> DataFrame:
    """connection, part and content of workbooks from rows (connection, bold, fill, cells) and headers (connection, cells).

    ``order`` has columns of the rows, or expressions of them, unique in a connection.
    """
    placed, taken = placed_rows(rows, order)
    placed = placed.withColumn("at", F.col("row_number") - 2).select(
        "connection", F.expr(f"at div {rows_per_sheet}").alias("part"), (F.col("at") % rows_per_sheet + 2).alias("number"), "bold", "fill", "cells"
    )
    parts = F.explode(F.expr(f"sequence((first - 2) div {rows_per_sheet}, (last - 2) div {rows_per_sheet})")).alias("part")
    tops = taken.select("connection", parts).distinct().join(headers.select("connection", "cells"), "connection")
    tops = tops.select("connection", "part", F.lit(1).cast("long").alias("number"), F.lit(True).alias("bold"), F.lit(None).cast("string").alias("fill"), "cells")
    return placed.unionByName(tops).groupBy("connection", "part").applyInArrow(_books, "connection string, part long, content binary")


def write_workbooks(books: DataFrame, path: str) -> None:
    """Write workbooks to ``path``/connection=<name>/part=<n>/sheet.xlsx, in place of what is there."""
    texts = books.select("connection", "part", F.col("content").cast("string").alias("value"))
    write_files(texts, ["connection", "part"], path, "sheet.xlsx")


def report_rows(report: DataFrame, dropped_title: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and headers of report workbooks from the annotated report, and their order: the snapshot, then under a title what it no longer has."""
    columns = {
        "db_name": "Database", "schema_name": "Schema", "table_name": "Tables", "column_name": "Columns", "datatype": "Datatype", "is_pii_raw": "IsPII",
    }
    marks = {"change_type": "ChangeType", "severity": "Severity", "action": "Action"}
    if "further" not in report.columns:
        report = report.withColumn("further", F.lit(None).cast("array<struct<name:string,value:string>>"))
    # at most as many names as a sheet has columns
    names = report.select("connection", F.explode("further.name").alias("name")).groupBy("connection").agg(F.array_sort(F.collect_set("name")).alias("names"))
    every = report.select("connection").distinct().join(names, "connection", "left").select("connection", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    value = lambda n: F.get(F.filter("further", lambda x: x["name"] == n), F.lit(0))["value"]
    cells = F.concat(F.array(*columns), F.transform("names", value), F.array(*marks))
    kind = F.when(F.col("row_kind") == "inventory", 0).otherwise(2).alias("kind")
    # the rows are ordered by cells, so that no text is carried twice
    keys = [f"get(cells, size(cells) - {len(marks)})", *[f"get(cells, {i})" for i, c in enumerate(columns) if c not in ("datatype", "is_pii_raw")]]
    body = join_facts(report, every, ["connection"], "column_name", "inner").select(
        "connection", kind, F.col("row_number").alias("place"), F.lit(False).alias("bold"), "fill", cells.alias("cells")
    )
    title = report.where("row_kind != 'inventory'").select("connection").distinct().select(
        "connection", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("place"),
        F.lit(True).alias("bold"), F.lit(None).cast("string").alias("fill"), F.array(F.lit(dropped_title)).alias("cells"),
    )
    headers = every.select("connection", F.concat(F.array(*[F.lit(x) for x in columns.values()]), "names", F.array(*[F.lit(x) for x in marks.values()])).alias("cells"))
    return body.unionByName(title), headers, ["kind", "place", *keys]
