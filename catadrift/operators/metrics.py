"""Counts of a comparison: side counts, the fourteen metrics, totals and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catadrift.config import (
    CHANGE_BARS,
    DATATYPE_CHANGED,
    DROPPED_COLUMN,
    DROPPED_DATABASE,
    DROPPED_SCHEMA,
    DROPPED_TABLE,
    DROPPED_TYPES,
    HIGH,
    LOW,
    MEDIUM,
    METRICS,
    NEW_COLUMN,
    NEW_DATABASE,
    NEW_SCHEMA,
    NEW_TABLE,
    NEW_TYPES,
    NO,
    SECTIONS,
    SEVERITY_BARS,
    TABLE_KEY,
    YES,
)

SIDE_COUNTS = (
    "tables_under_new_schema",
    "tables_under_dropped_schema",
    "pii_under_dropped_schema",
    "non_pii_under_dropped_schema",
)
# Which metric each side count adds to.
ADDS_TO = dict(
    zip(
        ("New Tables", "Dropped Tables", "Dropped PII Columns", "Dropped Non PII Columns"),
        SIDE_COUNTS,
        strict=True,
    )
)


def _sum(value: Column | str, condition: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    if condition is not None:
        value = F.when(condition, value)
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _one_row(by_database: DataFrame) -> DataFrame:
    """All metrics and side counts, from counts per change type and database."""

    def of(*change_types: str) -> Column:
        return F.col("change_type").isin(*change_types)

    one = F.lit(1)
    values = {
        "New Databases": _sum(one, of(NEW_DATABASE)),
        "Dropped Databases": _sum(one, of(DROPPED_DATABASE)),
        "New Schemas": _sum("schemas", of(NEW_SCHEMA)),
        "Dropped Schemas": _sum("schemas", of(DROPPED_SCHEMA)),
        "New Tables": _sum("tables", of(NEW_TABLE)),
        "Dropped Tables": _sum("tables", of(DROPPED_TABLE)),
        "New PII Columns": _sum("yes", of(*NEW_TYPES)),
        "New Non PII Columns": _sum("no", of(*NEW_TYPES)),
        "Dropped PII Columns": _sum("yes", of(*DROPPED_TYPES)),
        "Dropped Non PII Columns": _sum("no", of(*DROPPED_TYPES)),
        "Datatype Changes": _sum("n", of(DATATYPE_CHANGED)),
        "HIGH Severity": _sum("high"),
        "MEDIUM Severity": _sum("medium"),
        "LOW Severity": _sum("low"),
        "New Column Rows": _sum("n", of(NEW_COLUMN)),
        "Dropped Column Rows": _sum("n", of(DROPPED_COLUMN)),
        SIDE_COUNTS[0]: _sum("tables", of(NEW_SCHEMA)),
        SIDE_COUNTS[1]: _sum("tables", of(DROPPED_SCHEMA)),
        SIDE_COUNTS[2]: _sum("below_yes", of(DROPPED_SCHEMA)),
        SIDE_COUNTS[3]: _sum("below_no", of(DROPPED_SCHEMA)),
    }
    return by_database.agg(*[value.alias(name) for name, value in values.items()])


def _add_side_counts(row: DataFrame) -> DataFrame:
    return row.withColumns(
        {metric: F.col(f"`{metric}`") + F.col(side) for metric, side in ADDS_TO.items()}
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """One row with all metrics and side counts, straight from the changed keys.

    Counting level by level gives the distinct names on the way, and how many drift rows a
    group of keys stands for follows from its counts, so the changes are read once and the
    drift rows need not be made.
    """
    flag = "coalesce(curr.is_pii, prev.is_pii)"
    dropped_table = f"change_type = '{DROPPED_TABLE}'"
    per_schema = f"change_type IN ('{NEW_DATABASE}', '{DROPPED_DATABASE}', '{DROPPED_SCHEMA}')"
    dropped_schema = f"change_type IN ('{DROPPED_DATABASE}', '{DROPPED_SCHEMA}')"
    column_type = f"change_type IN ('{NEW_COLUMN}', '{DROPPED_COLUMN}')"
    counters = ("n", "yes", "no")

    by_table = (
        changes.groupBy("change_type", *TABLE_KEY)
        .agg(
            F.count("*").alias("n"),
            F.expr(f"count_if({flag} = '{YES}') AS yes"),
            F.expr(f"count_if({flag} = '{NO}') AS no"),
        )
        # A dropped table is its personal data, or else a single No.
        .selectExpr(
            "change_type", *TABLE_KEY, "yes",
            f"IF({dropped_table}, greatest(yes, 1), n) AS n",
            f"IF({dropped_table}, IF(yes > 0, 0, 1), no) AS no",
        )
    )
    by_schema = (
        by_table.groupBy("change_type", *TABLE_KEY[:3])
        .agg(F.count("*").alias("tables"), *[F.sum(c).alias(c) for c in counters])
        .selectExpr(
            "change_type", *TABLE_KEY[:3], "tables", "yes AS below_yes", "no AS below_no",
            f"IF({per_schema}, 1, n) AS n",
            f"IF({per_schema}, IF({dropped_schema} AND yes > 0, 1, 0), yes) AS yes",
            f"IF({per_schema}, IF({dropped_schema} AND yes = 0, 1, 0), no) AS no",
        )
    )
    by_database = (
        by_schema.groupBy("change_type", *TABLE_KEY[:2])
        .agg(
            F.count("*").alias("schemas"),
            *[F.sum(c).alias(c) for c in ("tables", "below_yes", "below_no", *counters)],
        )
        .selectExpr(
            "*",
            f"IF(change_type = '{NEW_DATABASE}', n, yes) AS high",
            f"IF({column_type}, n - yes, 0) AS low",
            f"IF({column_type} OR change_type = '{NEW_DATABASE}', 0, n - yes) AS medium",
        )
    )
    return _add_side_counts(_one_row(by_database))


def side_counts(counts: DataFrame) -> DataFrame:
    """The counts below new and dropped schemas of databases that are common."""
    return counts.select(*SIDE_COUNTS)


def drift_counts(drift: DataFrame, sides: DataFrame) -> DataFrame:
    """The same row from drift rows, such as stored ones, and the row of side counts.

    Distinct names are again counted level by level; a distinct count per metric would copy
    every drift row for each of them.
    """
    flags = {
        "yes": F.col("is_pii") == YES,
        "no": F.col("is_pii") == NO,
        "high": F.col("severity") == HIGH,
        "medium": F.col("severity") == MEDIUM,
        "low": F.col("severity") == LOW,
    }
    counters = ["n", *flags]
    by_table = drift.groupBy("change_type", *TABLE_KEY).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()]
    )
    by_schema = by_table.groupBy("change_type", *TABLE_KEY[:3]).agg(
        F.count("*").alias("tables"), *[F.sum(c).alias(c) for c in counters]
    )
    by_database = by_schema.groupBy("change_type", *TABLE_KEY[:2]).agg(
        F.count("*").alias("schemas"), *[F.sum(c).alias(c) for c in ("tables", *counters)]
    )
    empty = {"below_yes": F.lit(0), "below_no": F.lit(0)}
    from_drift = _one_row(by_database.withColumns(empty)).drop(*SIDE_COUNTS)
    names = from_drift.columns
    rows = from_drift.unionByName(sides.select(*SIDE_COUNTS), allowMissingColumns=True)
    return _add_side_counts(rows.agg(*[_sum(f"`{n}`").alias(n) for n in (*names, *SIDE_COUNTS)]))


def drift_summary(wide: DataFrame) -> DataFrame:
    """The metrics in rows: section, order inside the report, metric, count."""
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(METRICS.index(name) + 1).alias("ord"),
            F.lit(name).alias("metric"),
            F.col(f"`{name}`").alias("count"),
        )
        for section, names in SECTIONS.items()
        for name in names
    ]
    return wide.select(F.inline(F.array(*rows)))


def change_totals(wide: DataFrame) -> DataFrame:
    """Totals per level, and the rows of new and dropped columns."""
    parts = {
        "Database changes": ("New Databases", "Dropped Databases"),
        "Schema changes": ("New Schemas", "Dropped Schemas"),
        "Table changes": ("New Tables", "Dropped Tables"),
        "Column changes": SECTIONS["COLUMN LEVEL"],
        "New column rows": ("New Column Rows",),
        "Dropped column rows": ("Dropped Column Rows",),
    }
    rows = [
        F.struct(
            F.lit(name).alias("total"),
            sum((F.col(f"`{m}`") for m in members), F.lit(0)).cast("long").alias("count"),
        )
        for name, members in parts.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def _bars(wide: DataFrame, bars: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Bars of a chart, as long in percent of the longest as whole numbers go."""
    longest = F.greatest(F.lit(1), *[F.col(f"`{metric}`") for _, metric, _ in bars])
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(label).alias("label"),
            F.col(f"`{metric}`").alias("value"),
            F.floor(F.col(f"`{metric}`") / longest * 100).cast("int").alias("width"),
            F.lit(colour).alias("colour"),
        )
        for i, (label, metric, colour) in enumerate(bars, 1)
    ]
    return wide.select(F.inline(F.array(*rows)))


def bars_by_change(wide: DataFrame) -> DataFrame:
    """Bars of the changes that occur."""
    return _bars(wide, CHANGE_BARS).filter("value > 0")


def bars_by_severity(wide: DataFrame) -> DataFrame:
    return _bars(wide, SEVERITY_BARS)
