"""The comparison as a whole: two snapshots in, every result out as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, DRIFT, DROPPED_TITLE, INVENTORY, DriftConfig
from catadrift.functions import strip
from catadrift.operators import changes as ch
from catadrift.operators import matching, metrics, pages, quality, reports
from catadrift.operators.headers import connection_status, failed_connections
from catadrift.plans.session import cut, join_salted, shuffles_freed
from catadrift.sources import checks, sheets, sinks, workbooks
from catadrift.sources.inventory import read_inventory


class Comparison:
    """Results of comparing two inventories; each attribute is a lazy DataFrame.

    ``status`` is what :func:`headers.connection_status` found; connections that failed are
    left out whole. ``comparison_ts`` stamps the drift rows of a run. A ``further`` column of
    the current inventory, with what else its sheets hold, is kept in the annotated copy.
    """

    def __init__(
        self,
        prev: DataFrame,
        curr: DataFrame,
        status: DataFrame | None = None,
        comparison_ts: str | None = None,
        config: DriftConfig = DEFAULT,
    ) -> None:
        self.prev = prev.select(*INVENTORY)
        self.curr = curr.select(*INVENTORY, *[c for c in curr.columns if c == "further"])
        self.status = status
        self.comparison_ts = comparison_ts
        self.config = config

    @cached_property
    def connection_status(self) -> DataFrame:
        """Every connection on both sides, whether it was compared, and why not."""
        if self.status is not None:
            return self.status.withColumn("connection", strip("connection"))
        common = matching.common_connections(self.prev, self.curr)
        return common.selectExpr("connection", "'ok' AS status", "'' AS reason")

    @cached_property
    def failed(self) -> DataFrame | None:
        return None if self.status is None else failed_connections(self.connection_status)

    @cached_property
    def sides(self) -> DataFrame:
        return matching.both_sides(self.prev, self.curr, self.config)

    @cached_property
    def keys(self) -> DataFrame:
        return matching.match_keys(self.sides)

    @cached_property
    def names(self) -> dict[str, DataFrame]:
        return matching.hierarchy(self.sides)

    @cached_property
    def presence(self) -> DataFrame:
        return matching.presence(self.keys, self.names)

    def names_by_change(self, level: str, change: str) -> DataFrame:
        return matching.names_by_change(self.keys, self.names, level, change)

    @cached_property
    def changes(self) -> DataFrame:
        """Changed keys; failed connections go last, when only drift is left to filter."""
        return self._classified(lambda df: df)

    def _classified(self, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
        found = ch.classify(self.keys, self.names, stage)
        if self.failed is not None:
            found = join_salted(
                found, self.failed, ["connection"], "column_name", "left_anti"
            )
        return found

    def materialise(self) -> Comparison:
        """Compute the changed keys now and let all results start from them.

        Keys, names and the join of both are computed one after the other, so that the shuffle files of one are gone
        when the next begins.
        """
        if "changes" not in self.__dict__:
            self.changes = self._classified(cut)
        self.changes = cut(self.changes)
        return self

    @cached_property
    def drift(self) -> DataFrame:
        rows = ch.drift_rows(self.changes)
        if self.comparison_ts is not None:
            stamp = F.date_format(F.lit(self.comparison_ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
            rows = rows.select(stamp.alias("comparison_ts"), *DRIFT)
        return rows

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.change_counts(self.changes)

    @cached_property
    def side_counts(self) -> DataFrame:
        return metrics.side_counts(self.metrics)

    @cached_property
    def drift_summary(self) -> DataFrame:
        return metrics.drift_summary(self.metrics)

    @cached_property
    def annotated_inventory(self) -> DataFrame:
        anchored = ch.drift_rows(self.changes, with_anchor=True)
        return reports.annotate(self.curr, anchored, self.config)

    @cached_property
    def dropped_section(self) -> DataFrame:
        return reports.dropped_section(self.drift, self.config)

    @cached_property
    def critical_changes(self) -> DataFrame:
        return reports.critical_changes(self.drift)

    @cached_property
    def rejected_rows(self) -> DataFrame:
        def side(df: DataFrame, name: str) -> DataFrame:
            # Filtered as they are, so that the filter reaches the source.
            rows = quality.clean(quality.rejected_rows(df), "strip", self.config)
            return rows.select(F.lit(name).alias("side"), *INVENTORY, "reason")

        return side(self.prev, "prev").unionByName(side(self.curr, "curr"))

    @cached_property
    def run_status(self) -> DataFrame:
        return reports.run_status(self.drift, self.failed)

    @cached_property
    def reports(self) -> dict[str, DataFrame]:
        """All data sets of a run by name."""
        return {
            "connection_status": self.connection_status,
            "rejected_rows": self.rejected_rows,
            "drift": self.drift,
            "annotated_inventory": reports.annotated_report(self.annotated_inventory, self.dropped_section),
            "critical_changes": self.critical_changes,
            "critical_table": reports.critical_table(self.drift, self.config),
            "drift_summary": self.drift_summary,
            "change_totals": metrics.change_totals(self.metrics),
            "bars_by_change": metrics.bars_by_change(self.metrics),
            "bars_by_severity": metrics.bars_by_severity(self.metrics),
            "drift_by_connection": reports.drift_by_connection(self.drift),
            "run_status": self.run_status,
        }

    def write(self, path: str, fmt: str = "parquet") -> int:
        """Write all data sets below ``path``, the empty ones too, and return the run status.

        The changed keys are computed once and every data set starts from them. What an earlier
        run wrote to the same path is replaced.
        """
        self.materialise()
        by_connection = {"rejected_rows", "drift", "annotated_inventory", "critical_changes"}
        for name, df in self.reports.items():
            write = sinks.write_by_connection if name in by_connection else sinks.write_plain
            write(df, f"{path}/{name}", fmt)
        return self.run_status.first()["status"]

    @cached_property
    def workbooks(self) -> DataFrame:
        """connection, part and content of the report's workbooks: the annotated copy, and below it what it no longer has."""
        # headers, titles and rows all start from it
        report = cut(reports.annotated_report(self.annotated_inventory, self.dropped_section))
        with shuffles_freed(report.sparkSession):
            # archives gain nothing from being cut as columns
            return workbooks.workbooks(*workbooks.report_rows(report, DROPPED_TITLE)).checkpoint()

    @cached_property
    def critical_pages(self) -> DataFrame:
        """connection, page, n_rows and html of the critical changes."""
        return pages.critical_pages(reports.critical_table(self.drift, self.config))

    @cached_property
    def summary_page(self) -> DataFrame:
        """One row, html."""
        found = (metrics.drift_summary, metrics.change_totals, metrics.bars_by_change, metrics.bars_by_severity)
        return pages.summary_page(*[f(self.metrics) for f in found], self.critical_pages)

    def write_documents(self, path: str) -> None:
        """Write the report for people: workbooks and web pages, in place of what an earlier run left."""
        self.materialise()
        workbooks.write_workbooks(self.workbooks, f"{path}/workbooks")
        sinks.write_files(self.critical_pages.withColumnRenamed("html", "value"), ["connection", "page"], f"{path}/critical", "page.html")
        summary = self.summary_page.select(F.lit("summary").alias("report"), F.col("html").alias("value"))
        sinks.write_files(summary, ["report"], f"{path}/pages", "index.html")


def compare(
    prev: DataFrame,
    curr: DataFrame,
    status: DataFrame | None = None,
    comparison_ts: str | None = None,
    config: DriftConfig = DEFAULT,
) -> Comparison:
    """Compare two inventories that have at least one connection in common."""
    checks.check_connections(prev, curr)
    return Comparison(prev, curr, status, comparison_ts, config)


def compare_sheets(
    spark: SparkSession,
    previous: str,
    current: str,
    config: DriftConfig = DEFAULT,
    comparison_ts: str | None = None,
    fmt: str = "csv",
) -> Comparison:
    """Compare two folders of CSV sheets, or two workbooks (``fmt="xlsx"``), whose headers differ from connection to connection.

    A workbook is a file or a folder of files, a connection each of its sheets. Connections whose headers cannot be resolved on either side are left out whole, and the
    run status tells that the run was partial.
    """
    read_headers, read_rows = {
        "csv": (sheets.csv_sheet_headers, sheets.csv_sheets), "xlsx": (workbooks.workbook_headers, workbooks.workbook_sheets)
    }[fmt]
    checks.check_locations(previous, current, fmt)
    # a row per header, read once for all checks
    headers = [cut(read_headers(spark, path)) for path in (previous, current)]
    bodies = [read_rows(spark, path) for path in (previous, current)]
    checks.check_connections(*headers)
    checks.check_headers(*headers, headers[0])
    stripped = [h.withColumn("connection", strip("connection")) for h in headers]
    status = cut(connection_status(*stripped, config))
    prev, curr = (
        sheets.sheet_inventory(body, head, config)
        for body, head in zip(bodies, headers, strict=True)
    )
    return Comparison(prev, curr, status, comparison_ts, config)


def compare_locations(
    spark: SparkSession,
    previous: str,
    current: str,
    fmt: str = "parquet",
    config: DriftConfig = DEFAULT,
    comparison_ts: str | None = None,
    connection: str | None = None,
    **options: str,
) -> Comparison:
    """Compare two snapshots by path or table name."""
    checks.check_locations(previous, current, fmt)
    prev = read_inventory(spark, previous, fmt, connection, config, **options)
    curr = read_inventory(spark, current, fmt, connection, config, **options)
    return compare(prev, curr, comparison_ts=comparison_ts, config=config)
