"""Catalog snapshots derived from the ``lineitem`` table, for queries, tests and benchmarks.

Integer arithmetic alone decides what a row becomes, so any engine derives the same snapshots
and they grow with the table. See ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catadrift.config import INVENTORY, KEY

DATATYPES = ("VARCHAR", "INT", "DATE", "DECIMAL(10,2)", "CHAR(1)")
FLAGS = ("Yes", " y ", "TRUE", "1", "PII", "No", "n ", "False", "0", "non-PII", "maybe", None)
# Whitespace put before and after names in the messy snapshots.
BEFORE = ("", " ", "\t", "\u00a0", "\u2003")
AFTER = ("", " ", "\x1f", "\u3000")
# Spellings of the header at each place of a derived sheet.
SPELLINGS = (
    ("Database", "DatabaseName", " DB_NAME ", "DB"),
    ("Schema", "SchemaName", "db_schema", "TABLE_SCHEMA"),
    ("Tables", "TABLE_NAME", "tbl", "Table "),
    ("Columns", "column_name", "field", "Collation"),
    ("Datatype", "DATA_TYPE", "dtype", "column_type"),
    ("IsPII", "is_pii", "Sensitive", "PII"),
    ("Comment", "Owner", "Type note", "Field order"),
)
# Distance of the row positions of two parts.
POSITION_STEP = 1 << 28


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _pick(values: tuple, index: str) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({quoted}), CAST({index} + 1 AS INT))"


def inventory(spark: SparkSession, sf_dir: str, side: str, messy: bool = False) -> DataFrame:
    """The ``prev`` or ``curr`` snapshot; messy adds padding and nulls to names and types."""
    if side == "prev":
        left_out = "k % 12 = 11 OR k % 60 IN (4, 17) OR t % 20 = 3 OR c % 13 = 0 OR k % 97 = 1"
        kind = "p % 5"
        null_type = "p % 9 = 4 OR p % 13 = 6"
    else:
        left_out = "k % 12 = 10 OR k % 60 IN (5, 18) OR t % 20 = 5 OR c % 13 = 1 OR k % 97 = 0"
        kind = "(p % 5 + IF(c % 17 = 2, 1, 0)) % 5"
        null_type = "p % 9 = 4 OR p % 11 = 5"
    columns = {
        "connection": "CASE k % 97 WHEN 0 THEN 'conn_prev_only' WHEN 1 THEN 'conn_curr_only' "
        "ELSE concat('conn_', k % 4) END",
        "db_name": "concat('db_', k % 12)",
        "schema_name": "concat('sch_', k % 60)",
        "table_name": "concat('tbl_', k)",
        "column_name": "concat('col_', line)",
        "datatype": _pick(DATATYPES, kind),
        "is_pii_raw": f"IF(t % 4 = 1 OR k % 60 IN (18, 22), 'no', {_pick(FLAGS, 'p % 12')})",
        "row_number": f"p * {POSITION_STEP} + s % {POSITION_STEP}",
    }
    padded = {}
    if messy:
        before, after = _pick(BEFORE, "s % 5"), _pick(AFTER, "s % 4")
        padded = {
            "connection": ("s % 59 = 11", "concat(IF(s % 7 = 2, ' ', ''), {})"),
            "db_name": ("s % 41 = 3", f"concat({before}, {{}}, {after})"),
            "schema_name": ("s % 43 = 5", f"concat({{}}, {before})"),
            "table_name": ("s % 47 = 7", f"concat({after}, {{}})"),
            "column_name": ("s % 53 = 9", "{}"),
        }
        columns["datatype"] = f"IF({null_type}, NULL, concat({columns['datatype']}, {before}))"
    # Of its parts only the order or line can be null. As this is said outside of a name, a filter
    # on names that are null need not make them first.
    for name in KEY:
        is_null, value = padded.get(name, ("false", "{}"))
        part = "line" if name == "column_name" else "k"
        columns[name] = f"IF({part} IS NULL OR {is_null}, NULL, coalesce({value.format(columns[name])}, ''))"
    return (
        lineitem(spark, sf_dir)
        .selectExpr(
            "l_orderkey AS k", "l_linenumber AS line", "l_partkey AS p", "l_suppkey AS s",
            "l_orderkey div 60 AS t", "l_orderkey + l_linenumber AS c",
        )
        .filter(f"NOT ({left_out})")
        .selectExpr(*[f"{columns[c]} AS {c}" for c in INVENTORY])
    )


def _sheets(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Rows by sheet; a few sheets are on one side only."""
    absent = 1 if side == "prev" else 0
    return (
        lineitem(spark, sf_dir)
        .withColumn("sheet", F.expr("l_orderkey div 8"))
        .filter(f"sheet % 23 != {absent}")
    )


def sheet_headers(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Header rows of derived sheets, spelled in many ways, some of them misleading."""
    shift = "0" if side == "prev" else "IF(sheet % 5 = 0, 1, 0)"
    spelled = " ".join(
        f"WHEN {place} THEN {_pick(values, f'(p + {shift}) % 4')}"
        for place, values in enumerate(SPELLINGS, 1)
    )
    return (
        _sheets(spark, sf_dir, side)
        .groupBy("sheet", F.col("l_linenumber").alias("pos"))
        .agg(F.min("l_partkey").alias("p"))
        .selectExpr("concat('sheet_', sheet) AS connection", "pos", f"CASE pos {spelled} END AS header")
    )


def sheet_rows(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Bodies of the derived sheets."""
    cells = ", ".join(f"concat('v{place}_', l_partkey % 50)" for place in range(8))
    return _sheets(spark, sf_dir, side).selectExpr(
        "concat('sheet_', sheet) AS connection",
        f"l_partkey * {POSITION_STEP} + l_suppkey % {POSITION_STEP} AS row_number",
        f"array({cells}) AS cells",
    )
