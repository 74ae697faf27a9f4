"""Web pages of a comparison: a summary, and the critical changes in pages of bounded length, as text built in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catadrift.config import KEY
from catadrift.sources.positions import sheet_positions

ROWS_PER_PAGE = 1_000

# What pages are made of.
TITLE = "PII Audit Drift Detection Report"
STYLE = (
    "body{font-family:Arial,sans-serif;color:#333;font-size:13px;margin:20px}table{border-collapse:collapse}"
    "th{background:#2c3e50;color:white;text-align:left}td,th{padding:6px 10px}.bar{display:inline-block;height:12px}"
)
HEADERS = ("Connection", "Database", "Schema", "Table", "Column", "IsPII", "Change Type", "Severity", "Action")
NO_CRITICAL = "No critical changes detected"
PAGE_START = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>{TITLE}</title><style>{STYLE}</style></head><body><h1>'
BODY_START, PAGE_END = "</h1>\n", "\n</body></html>"
TABLE_START = "<table><thead><tr>" + "".join(f"<th>{x}</th>" for x in HEADERS) + "</tr></thead><tbody>\n"
TABLE_END = "\n</tbody></table>"


def escaped(column: Column | str) -> Column:
    """Text that may stand in a page; nulls as nothing."""
    out = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def page(title: Column, body: Column) -> Column:
    return F.concat(F.lit(PAGE_START), title, F.lit(BODY_START), body, F.lit(PAGE_END))


def critical_pages(table: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """connection, page (from 1), n_rows and html from the critical table; rows by change type and key."""
    order = ["change_type", *KEY[1:]]
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in (*KEY, "is_pii", "change_type", "severity", "action")])
    row = F.concat(F.lit('<tr style="background:'), escaped("tint"), F.lit('">'), cells, F.lit("</tr>"))
    placed = sheet_positions(table.select("connection", *order, row.alias("row")), order)
    at = (F.col("row_number") - 2).alias("at")
    pages = placed.select("connection", F.expr(f"(row_number - 2) div {rows_per_page} + 1").alias("page"), at, "row")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), "\n")
    body = F.concat(F.lit(TABLE_START), F.col("rows"), F.lit(TABLE_END))
    title = F.concat(F.lit("Critical changes of "), escaped("connection"), F.lit(", page "), F.col("page").cast("string"))
    found = pages.groupBy("connection", "page").agg(F.count(F.lit(1)).alias("n_rows"), rows.alias("rows"))
    return found.select("connection", "page", "n_rows", page(title, body).alias("html"))


def _lines(df: DataFrame, order: list[str], line: Column, name: str) -> DataFrame:
    """One row: the lines of a few rows in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")
    return df.agg(joined.alias(name))


def _bar() -> Column:
    return F.concat(
        F.lit("<p>"), escaped("label"), F.lit(' <span class="bar" style="width:'), F.col("width").cast("string"), F.lit("%;background:"), F.col("colour"),
        F.lit('"></span> '), F.col("value").cast("string"), F.lit("</p>"),
    )


def summary_page(summary: DataFrame, totals: DataFrame, by_change: DataFrame, by_severity: DataFrame, critical: DataFrame) -> DataFrame:
    """One row, html: totals, the metrics by section, both bar charts, and a link per connection with critical changes.

    ``summary``, ``totals`` and the bars have a fixed number of rows; ``critical`` has columns connection and n_rows, a row per page.
    """
    metric = F.concat(F.lit("<tr><td>"), escaped("section"), F.lit("</td><td>"), escaped("metric"), F.lit("</td><td>"), F.col("count").cast("string"), F.lit("</td></tr>"))
    total = F.concat(F.lit("<p><b>"), F.col("count").cast("string"), F.lit("</b> "), escaped("total"), F.lit("</p>"))
    linked = critical.groupBy("connection").agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("pages"))
    link = F.concat(
        F.lit("<p>"), escaped("connection"), F.lit(": "), F.col("n").cast("string"), F.lit(" critical changes on "), F.col("pages").cast("string"), F.lit(" pages</p>")
    )
    parts = [
        _lines(totals, ["total"], total, "totals"),
        _lines(summary, ["ord"], metric, "metrics"),
        _lines(by_change, ["ord"], _bar(), "changes"),
        _lines(by_severity, ["ord"], _bar(), "severities"),
        _lines(linked, ["connection"], link, "links"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # of one row each
    links = F.when(F.col("links") == "", F.lit(f"<p>{NO_CRITICAL}</p>")).otherwise(F.col("links"))
    body = F.concat(
        F.col("totals"), F.lit("\n<h2>Consolidated Drift Summary</h2>\n<table>\n"), F.col("metrics"), F.lit("\n</table>\n<h2>Changes by Type</h2>\n"),
        F.col("changes"), F.lit("\n<h2>Changes by Severity</h2>\n"), F.col("severities"),
        F.lit("\n<h2>Consolidated Critical Changes</h2>\n"), links,
    )
    return whole.select(page(F.lit(TITLE), body).alias("html"))
