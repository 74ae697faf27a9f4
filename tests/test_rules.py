"""Rules on rows: whitespace, flag spelling, headers, severity, highlight, tint."""

import itertools

import pytest
from pyspark.sql import functions as F

from catadrift.config import (
    ACTIONS,
    HEADER_PATTERNS,
    NO_VALUES,
    YES_VALUES,
    DriftConfig,
)
from catadrift.functions import lookup, normalise_pii, strip
from catadrift.functions.text import WHITESPACE
from catadrift.operators import changes, headers, quality
from catadrift.config import HIGHLIGHTS, TINTS
from catadrift.sources.inventory import resolve_headers
from tests.snapshots import frame

TEXTS = [
    "", " ", "a", " a ", "\ta\t", "a b", "\u00a0a\u00a0", "\u2003a", "a\u3000", "\u0085a", "a\u2028",
    "\x0ba", "\x1ca\x1f", "\x1da\x1e", "a\r\n", "\u200ba\u200b", "\ufeffa", "\u1680a", " \t\u00a0 ", "\u00e9 ", "'q' ",
]


def test_strip_is_python_strip(spark):
    texts = TEXTS + [f"{c}x{c}" for c in WHITESPACE] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for row in df.select("t", strip("t").alias("s")).collect():
        assert row.s == (None if row.t is None else row.t.strip())


def test_whitespace_is_complete():
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(WHITESPACE)


def test_flag_spellings(spark):
    pads = ["", " ", "\t", "\u00a0", "\x1f"]
    cases = {}
    for value, flag in [*((v, "Yes") for v in YES_VALUES), *((v, "No") for v in NO_VALUES)]:
        for pad, text in itertools.product(pads, (value, value.upper(), value.title())):
            cases[pad + text + pad] = flag
    cases |= {"": "Unknown", "maybe": "Unknown", "1.0": "Unknown", "yess": "Unknown", "n/a": "Unknown"}
    df = spark.createDataFrame([*((t, f) for t, f in cases.items()), (None, "Unknown")], "t STRING, f STRING")
    assert df.filter(normalise_pii("t") != F.col("f")).isEmpty()


def test_flag_spellings_can_be_set(spark):
    config = DriftConfig(yes_values=("ja", "d'accord"), no_values=("nein",))
    df = spark.createDataFrame([("JA",), ("d'accord",), ("nein",), ("yes",)], "t STRING")
    found = [r[0] for r in df.select(normalise_pii("t", config)).collect()]
    assert found == ["Yes", "Yes", "No", "Unknown"]


def test_severity_and_action(spark):
    pairs = [(c, f) for c in ACTIONS for f in ("Yes", "No", "Unknown")]
    df = spark.createDataFrame(pairs, "change_type STRING, is_pii STRING")
    found = df.select("*", changes.severity(), changes.action()).collect()
    for row in found:
        if row.is_pii == "Yes" or row.change_type == "New Database Added":
            expected = "HIGH"
        elif row.change_type in ("New Column Added", "Column Dropped"):
            expected = "LOW"
        else:
            expected = "MEDIUM"
        assert row.severity == expected
        assert row.action == ACTIONS[row.change_type][row.is_pii != "Yes"]


@pytest.mark.parametrize("table", [HIGHLIGHTS, TINTS])
def test_lookup(spark, table):
    pairs = [(c, f) for c in ACTIONS for f in ("Yes", "No", "Unknown", "N/A")]
    df = spark.createDataFrame(pairs, "change_type STRING, is_pii STRING")
    for row in df.select("*", lookup(table, "change_type", "is_pii").alias("v")).collect():
        assert row.v == table[row.change_type].get(row.is_pii)


HEADER_CASES = {
    "spelled out": (
        ["DatabaseName", "SchemaName", "TableName", "ColumnName", "DataType", "Is_PII"], {},
    ),
    "bare DB": (
        ["DB", "Schema", "Table", "Column", "Type", "PII"], {"Database": 0},
    ),
    "table schema": (
        ["db_name", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "Sensitive"], {"Schema": 0},
    ),
    "column type first": (
        ["Database", "Schema", "Tables", "column_type", "Columns", "IsPII"], {},
    ),
    "collation": (
        ["Database", "db_schema", "tbl", "Collation", "field", "dtype", "is_pii"], {},
    ),
    "two databases": (
        ["DatabaseName", "Database", "Schema", "Tables", "Columns", "Datatype", "IsPII"], {"Database": 2},
    ),
    "padded": (
        [" Database ", "schema\t", "Tables", "Columns", "Datatype", "IsPII"], {},
    ),
}


@pytest.fixture(scope="module")
def header_rows(spark):
    data = [
        (case, pos, header)
        for case, (found, _) in HEADER_CASES.items()
        for pos, header in enumerate(found)
    ]
    return spark.createDataFrame(data, "connection STRING, pos INT, header STRING")


def test_header_map(header_rows):
    found = {}
    for row in headers.header_map(header_rows).orderBy("connection", "ord").collect():
        found.setdefault(row.connection, []).append(row.actual_name)
    assert found["spelled out"] == HEADER_CASES["spelled out"][0]
    assert found["bare DB"][0] == "Database"
    assert found["table schema"][1:3] == ["TABLE_SCHEMA", "TABLE_SCHEMA"]
    assert found["column type first"][3:5] == ["column_type", "column_type"]
    assert found["collation"][3] == "Collation"
    assert found["padded"][0] == " Database "


def test_header_conflicts(header_rows):
    found = {}
    for row in headers.header_conflicts(header_rows).collect():
        found.setdefault(row.connection, {})[row.standard_name] = row.n_columns
    assert found == {case: bad for case, (_, bad) in HEADER_CASES.items() if bad}


def test_header_rename_of_a_doubly_claimed_header(header_rows):
    found = {
        r.header: r.new_name
        for r in headers.header_rename(header_rows).filter("connection = 'column type first'").collect()
    }
    assert found["column_type"] == "Datatype"
    assert found["Columns"] == "Columns"


@pytest.mark.parametrize("case", sorted(HEADER_CASES))
def test_one_layout_resolves_as_rows_do(header_rows, case):
    found, bad = HEADER_CASES[case]
    if bad:
        with pytest.raises(ValueError, match=next(iter(bad))):
            resolve_headers(found)
    else:
        renamed = {
            r.pos: r.new_name
            for r in headers.header_rename(header_rows).filter(F.col("connection") == case).collect()
        }
        assert {name: renamed[pos] for name, pos in resolve_headers(found).items()} == {
            name: name for name in HEADER_PATTERNS
        }


def test_connection_status(spark, header_rows):
    good = headers.header_rename(header_rows).filter("connection != 'padded'").selectExpr(
        "connection", "pos", "header"
    )
    status = {r.connection: (r.status, r.reason) for r in headers.connection_status(header_rows, good).collect()}
    assert "padded" not in status
    assert status["spelled out"] == ("ok", "")
    assert status["bare DB"] == ("failed", "prev lacks Database; curr lacks Database")
    assert status["two databases"][1].startswith("prev doubles Database")


def test_clean_modes(spark):
    raw = [
        ("C", " d", "s", "t", "c", "INT ", " Y ", 2),
        ("C", "d", "s", "t", "c", "INT", "no", 3),
        ("C", "d", "s", "t", "c", "CHAR", "no", 4),
        ("C", "d", None, "t", "c", "INT", None, 5),
        ("C", "d", None, "t", "c", "INT", "1", 6),
    ]
    df = frame(spark, raw)

    def positions(mode):
        return sorted(r.row_number for r in quality.clean(df, mode).collect())

    assert positions("all") == [2, 5]
    assert positions("strip") == [2, 3, 4, 5, 6]
    assert positions("dedup") == [2, 3, 5]
    first = quality.clean(df, "all").filter("row_number = 2").first()
    assert (first.db_name, first.datatype, first.is_pii) == ("d", "INT", "Yes")
    assert "is_pii" not in quality.clean(df, "dedup").columns
    removed = quality.duplicates(quality.clean(df, "strip")).collect()
    assert sorted((r.row_number, r.n_removed) for r in removed) == [(3, 1), (4, 1), (6, 1)]
    with pytest.raises(ValueError, match="mode"):
        quality.clean(df, "none")


def test_equal_rows_are_removed_all_but_one(spark):
    df = frame(spark, [("C", "d", "s", "t", "c", "INT", "y", 2)] * 4)
    assert quality.dedup_first(df).count() == 1
    assert [r.n_removed for r in quality.duplicates(df).collect()] == [3]
