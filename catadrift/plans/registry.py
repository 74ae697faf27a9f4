"""Every operator as a query over the derived snapshots, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catadrift.config import (
    DATATYPE_CHANGED,
    DROPPED_COLUMN,
    DROPPED_DATABASE,
    DROPPED_SCHEMA,
    DROPPED_TABLE,
    INVENTORY,
    KEY,
    NEW_COLUMN,
    NEW_DATABASE,
    NEW_SCHEMA,
    NEW_TABLE,
)
from catadrift.operators import changes, headers, matching, metrics, quality, reports
from catadrift.plans.compare import Comparison
from catadrift.plans.derived import inventory, lineitem, sheet_headers, sheet_rows
from catadrift.plans.session import cut, ensure_checkpoint_dir
from catadrift.sources import checks, positions, sheets, workbooks

Query = Callable[[SparkSession, str], DataFrame]

DRIFT_QUERIES = {
    "drift_new_database": NEW_DATABASE,
    "drift_dropped_database": DROPPED_DATABASE,
    "drift_new_schema": NEW_SCHEMA,
    "drift_dropped_schema": DROPPED_SCHEMA,
    "drift_new_table": NEW_TABLE,
    "drift_dropped_table": DROPPED_TABLE,
    "drift_new_column": NEW_COLUMN,
    "drift_dropped_column": DROPPED_COLUMN,
    "drift_datatype_changed": DATATYPE_CHANGED,
}


def comparison(spark: SparkSession, sf_dir: str, messy: bool = False) -> Comparison:
    return Comparison(
        inventory(spark, sf_dir, "prev", messy), inventory(spark, sf_dir, "curr", messy)
    )


def _of_comparison(result: Callable[[Comparison], DataFrame], messy: bool = False) -> Query:
    return lambda spark, sf_dir: result(comparison(spark, sf_dir, messy))


def _of_current(result: Callable[[DataFrame], DataFrame]) -> Query:
    """Of the messy current snapshot."""
    return lambda spark, sf_dir: result(inventory(spark, sf_dir, "curr", messy=True))


def _of_inventories(result: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: result(
        inventory(spark, sf_dir, "prev", messy=True), inventory(spark, sf_dir, "curr", messy=True)
    )


def _of_headers(result: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: result(sheet_headers(spark, sf_dir, "curr"))


def _inventory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [
        inventory(spark, sf_dir, side).select(F.lit(side).alias("side"), *INVENTORY)
        for side in ("prev", "curr")
    ]
    return sides[0].unionByName(sides[1])


def _row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    connection = F.concat(F.lit("conn_"), (F.col("l_orderkey") % 4).cast("string"))
    rows = lineitem(spark, sf_dir).select(connection.alias("connection"), *order)
    return positions.sheet_positions(rows, order).select(
        "connection", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_number"
    )


def _presence(c: Comparison) -> DataFrame:
    return c.presence.select(*KEY, "in_prev", "in_curr", "missing")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.connection_status(
        sheet_headers(spark, sf_dir, "prev"), sheet_headers(spark, sf_dir, "curr")
    )


def _run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = headers.failed_connections(_status(spark, sf_dir))
    return reports.run_status(comparison(spark, sf_dir).drift, failed)


def _snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.snapshot_checks(
        sheet_rows(spark, sf_dir, "prev"),
        sheet_rows(spark, sf_dir, "curr"),
        sheet_headers(spark, sf_dir, "prev"),
    )


def _sheet_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sheet_inventory(
        sheet_rows(spark, sf_dir, "curr"), sheet_headers(spark, sf_dir, "curr")
    ).select(*INVENTORY)


def _read_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot written as CSV sheets, several files a connection, and read by the reader."""
    path = _scratch(spark, "sheets")
    columns = [F.col(c).alias(name) for name, c in sheets.STANDARD_COLUMNS.items()]
    inventory(spark, sf_dir, "curr").repartition(3).select("connection", F.lit("x").alias("Owner"), *columns).write.option(
        "header", True
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("connection").csv(path)
    return sheets.sheet_inventory(sheets.csv_sheets(spark, path), sheets.csv_sheet_headers(spark, path))


def _sheet_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.get("further", F.lit(0)).value.alias("owner")
    return _read_sheets(spark, sf_dir).select(*[c for c in INVENTORY if c != "row_number"], owner)


def _sheet_reader_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_sheets(spark, sf_dir).groupBy("connection").agg(
        F.count("*").alias("n_rows"), F.min("row_number").alias("first"), F.max("row_number").alias("last"),
        F.sum("row_number").alias("total"),
    )


def _annotated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written: annotated and dropped rows, with a further column of the sheets."""
    owner = F.concat(F.lit("o"), (F.col("row_number") % 7).cast("string"))
    further = F.array(F.struct(F.lit("Owner").alias("name"), owner.alias("value")))
    prev, curr = (inventory(spark, sf_dir, side, messy=True) for side in ("prev", "curr"))
    found = Comparison(prev, curr.withColumn("further", further)).materialise().reports["annotated_inventory"]
    return found.withColumn("owner", F.get("further", F.lit(0)).value).drop("further")


def _workbook_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy current snapshot written as workbooks, several a connection, and read by the reader."""
    path = _scratch(spark, "workbooks")
    rows = inventory(spark, sf_dir, "curr", messy=True).where("connection IS NOT NULL")
    cells = F.array(F.lit("x & <y>"), *sheets.STANDARD_COLUMNS.values())
    rows = rows.select("connection", F.col("row_number").alias("place"), F.lit(False).alias("bold"), F.lit(None).cast("string").alias("fill"), cells.alias("cells"))
    headers = rows.select("connection").distinct().withColumn("cells", F.array(F.lit("Owner"), *[F.lit(x) for x in sheets.STANDARD_COLUMNS]))
    order = ["place", *[f"get(cells, {list(sheets.STANDARD_COLUMNS.values()).index(k) + 1})" for k in KEY[1:]]]
    workbooks.write_workbooks(workbooks.workbooks(rows, headers, order, 5_000), path)
    # a row per header, read once for all checks
    found = sheets.sheet_inventory(workbooks.workbook_sheets(spark, path), cut(workbooks.workbook_headers(spark, path)))
    return found.select(*[c for c in INVENTORY if c != "row_number"], F.get("further", F.lit(0)).value.alias("owner"))


def _report_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's workbooks, written and read again: cells of every row, without empty ones at the end."""
    path = _scratch(spark, "report")
    workbooks.write_workbooks(comparison(spark, sf_dir).materialise().workbooks, path)
    line = F.rtrim(F.array_join("cells", "|", ""), F.lit("|"))
    return workbooks.workbook_sheets(spark, path).select("connection", line.alias("cells"))


def _scratch(spark: SparkSession, stem: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4().hex}"


def _normalised(df: DataFrame) -> DataFrame:
    flags = quality.add_pii_flag(df)
    return flags.groupBy("is_pii_raw", "is_pii").agg(F.count("*").alias("n_rows"))


def _names_query(level: str, change: str) -> Query:
    return _of_comparison(lambda c: c.names_by_change(level, change))


def _drift_query(change_type: str) -> Query:
    return _of_comparison(lambda c: c.drift.filter(F.col("change_type") == change_type))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        # Sources and checks.
        "inventory_scan": _inventory_scan,
        "connections": _of_current(matching.connections),
        "common_connections": _of_inventories(matching.common_connections),
        "unmatched_connections": _of_inventories(matching.unmatched_connections),
        "snapshot_checks": _snapshot_checks,
        "row_positions": _row_positions,
        # Headers.
        "header_map": _of_headers(headers.header_map),
        "header_rename": _of_headers(headers.header_rename),
        "header_conflicts": _of_headers(headers.header_conflicts),
        "connection_status": _status,
        "sheet_inventory": _sheet_inventory,
        "sheet_reader": _sheet_reader,
        "sheet_reader_positions": _sheet_reader_positions,
        "workbook_reader": _workbook_reader,
        # Cleaning.
        "clean_strip": _of_current(quality.strip_columns),
        "normalise_pii": _of_current(_normalised),
        "dedup_first": _of_current(lambda df: quality.dedup_first(quality.strip_columns(df))),
        "clean_all": _of_current(lambda df: quality.clean(df, "all")),
        "clean_strip_mode": _of_current(lambda df: quality.clean(df, "strip")),
        "clean_dedup_mode": _of_current(lambda df: quality.clean(df, "dedup")),
        "duplicates": _of_current(lambda df: quality.duplicates(quality.clean(df, "strip"))),
        "rejected_rows": _of_comparison(lambda c: c.rejected_rows, messy=True),
        # Matching and rules.
        "presence": _of_comparison(_presence),
        "pii_bubble_up": _of_comparison(lambda c: changes.pii_bubble_up(c.keys)),
        "severity_matrix": _of_comparison(lambda c: reports.severity_matrix(c.drift)),
        # Drift.
        "drift_all": _of_comparison(lambda c: c.drift),
        "drift_all_messy": _of_comparison(lambda c: c.drift, messy=True),
        # Aggregates.
        "side_counts": _of_comparison(lambda c: c.side_counts),
        "drift_summary": _of_comparison(lambda c: c.drift_summary),
        "drift_summary_messy": _of_comparison(lambda c: c.drift_summary, messy=True),
        "change_totals": _of_comparison(lambda c: metrics.change_totals(c.metrics)),
        "bars_by_change": _of_comparison(lambda c: metrics.bars_by_change(c.metrics)),
        "bars_by_severity": _of_comparison(lambda c: metrics.bars_by_severity(c.metrics)),
        # Reports.
        "highlight": _of_comparison(lambda c: reports.highlight(c.drift)),
        "annotated_inventory": _of_comparison(lambda c: c.annotated_inventory, messy=True),
        "annotated_report": _annotated_report,
        "dropped_section": _of_comparison(lambda c: c.dropped_section),
        "drift_sorted": _of_comparison(lambda c: reports.drift_sorted(c.drift)),
        "critical_changes": _of_comparison(lambda c: c.critical_changes),
        "critical_tint": _of_comparison(lambda c: reports.critical_table(c.drift)),
        "critical_pages": _of_comparison(lambda c: c.critical_pages),
        "report_workbook": _report_workbook,
        "drift_by_connection": _of_comparison(lambda c: reports.drift_by_connection(c.drift)),
        "run_status": _run_status,
    }
    for level in ("database", "schema", "table", "column"):
        for change in ("new", "dropped", "common"):
            found[f"{level}s_{change}"] = _names_query(level, change)
    for name, change_type in DRIFT_QUERIES.items():
        found[name] = _drift_query(change_type)
    return found
