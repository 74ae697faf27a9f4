"""The change types: which key changed, how, and what should be done about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catadrift.config import (
    ACTIONS,
    ARROW,
    DATATYPE_CHANGED,
    DRIFT,
    DROPPED_COLUMN,
    DROPPED_DATABASE,
    DROPPED_SCHEMA,
    DROPPED_TABLE,
    HIGH,
    KEY,
    LOW,
    MEDIUM,
    NEW_COLUMN,
    NEW_DATABASE,
    NEW_SCHEMA,
    NEW_TABLE,
    NO,
    NOT_APPLICABLE,
    NULL_TEXT,
    TABLE_KEY,
    UNKNOWN,
    YES,
)
from catadrift.operators.matching import LEVELS, gone_tables
from catadrift.plans.session import join_salted

# Change type by the highest missing level, for keys only in the current / previous side.
NEW_BY_LEVEL = {
    "database": NEW_DATABASE,
    "schema": NEW_SCHEMA,
    "table": NEW_TABLE,
    "column": NEW_COLUMN,
}
DROPPED_BY_LEVEL = {
    "database": DROPPED_DATABASE,
    "schema": DROPPED_SCHEMA,
    "table": DROPPED_TABLE,
    "column": DROPPED_COLUMN,
}
# Reported once per schema, whatever the number of columns below it.
SCHEMA_GRAIN = (NEW_DATABASE, DROPPED_DATABASE, DROPPED_SCHEMA)


def changed_keys(keys: DataFrame) -> DataFrame:
    """Keys on one side only, and those on both whose datatype text changed."""
    return keys.filter(
        "prev IS NULL OR curr IS NULL OR NOT (prev.datatype <=> curr.datatype)"
    )


def missing_tables(changed: DataFrame, names: dict[str, DataFrame]) -> DataFrame:
    """Tables that are missing on one side, and whether a dropped one had personal data in any column.

    Levels are numbers in that aggregate, as one over text would sort.
    """
    with_pii = changed.filter(f"prev.is_pii = '{YES}' AND curr IS NULL").selectExpr(
        *TABLE_KEY, "0 AS missing", "true AS table_pii"
    )
    levels = f"array({', '.join(f"'{level}'" for level in LEVELS)})"
    return (
        gone_tables(names)
        .selectExpr(
            *TABLE_KEY, f"CAST(array_position({levels}, missing) AS INT) AS missing", "false AS table_pii"
        )
        .unionByName(with_pii)
        .groupBy(*TABLE_KEY)
        .agg(F.expr("max(missing) AS missing"), F.expr("max(table_pii) AS table_pii"))
        .filter("missing > 0")
        .selectExpr(*TABLE_KEY, f"element_at({levels}, missing) AS missing", "table_pii")
    )


def classify(keys: DataFrame, names: dict[str, DataFrame], stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The changed keys, each with its single change type.

    The highest missing ancestor decides; a key on both sides has changed if its datatype
    text did. Keys of a connection that is on one side only are no change. Unchanged keys
    go before the join, so what it shuffles is as large as the drift, not as the catalog.

    ``table_pii`` tells whether a dropped table had personal data in any column. ``stage`` may materialise what either
    side of the join is made from.
    """
    changed = stage(changed_keys(keys))
    gone = stage(missing_tables(changed, names))

    def by_level(change_types: dict[str, str]) -> str:
        cases = " ".join(f"WHEN '{level}' THEN '{v}'" for level, v in change_types.items())
        return f"CASE coalesce(missing, 'column') {cases} END"

    return (
        join_salted(changed, gone, TABLE_KEY, "column_name")
        .selectExpr(
            *KEY, "prev", "curr",
            f"CASE WHEN prev IS NULL THEN {by_level(NEW_BY_LEVEL)} "
            f"WHEN curr IS NULL THEN {by_level(DROPPED_BY_LEVEL)} "
            f"ELSE '{DATATYPE_CHANGED}' END AS change_type",
            "coalesce(table_pii, false) AS table_pii",
        )
        .filter("change_type IS NOT NULL")
    )


def in_list(change_types: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in change_types) + ")"


def severity() -> Column:
    """HIGH for personal data and for a new database; how loud the rest is depends on type."""
    return F.expr(
        f"CASE WHEN is_pii = '{YES}' OR change_type = '{NEW_DATABASE}' THEN '{HIGH}' "
        f"WHEN change_type IN ('{NEW_COLUMN}', '{DROPPED_COLUMN}') THEN '{LOW}' "
        f"ELSE '{MEDIUM}' END AS severity"
    )


def action() -> Column:
    cases = " ".join(
        f"WHEN '{change}' THEN IF(is_pii = '{YES}', '{yes}', '{other}')"
        for change, (yes, other) in ACTIONS.items()
    )
    return F.expr(f"CASE change_type {cases} END AS action")


def drift_rows(changes: DataFrame, with_anchor: bool = False) -> DataFrame:
    """Drift rows at the grain each change type is reported at.

    One aggregate serves all types: a row reported per column is a group of its own, columns
    reported per schema or table share a group and are combined on the map side. The buffers
    are fixed-width, so it stays a hash aggregate.

    ``with_anchor`` adds the table and column of the row in the current snapshot that an
    annotation belongs to.
    """
    per_schema = f"change_type IN {in_list(SCHEMA_GRAIN)}"
    per_group = f"({per_schema} OR (change_type = '{DROPPED_TABLE}' AND NOT table_pii))"
    flag = "coalesce(curr.is_pii, prev.is_pii)"
    datatype = (
        f"CASE WHEN {per_group} THEN '{NOT_APPLICABLE}' "
        f"WHEN change_type = '{DATATYPE_CHANGED}' THEN concat("
        f"coalesce(prev.datatype, '{NULL_TEXT}'), '{ARROW}', coalesce(curr.datatype, '{NULL_TEXT}')) "
        "WHEN curr IS NULL THEN prev.datatype ELSE curr.datatype END"
    )
    rows = changes.filter(
        # Harmless columns of a dropped table are not reported beside its personal data.
        f"NOT (change_type = '{DROPPED_TABLE}' AND table_pii AND {flag} != '{YES}')"
    ).selectExpr(
        *KEY[:3],
        f"IF({per_schema}, '{NOT_APPLICABLE}', table_name) AS table_name",
        f"IF({per_group}, '{NOT_APPLICABLE}', column_name) AS column_name",
        f"{datatype} AS datatype",
        "change_type",
        f"CASE {flag} WHEN '{YES}' THEN 2 WHEN '{NO}' THEN 1 ELSE 0 END AS flag_rank",
        "curr.row_number AS row_number",
        "struct(curr.row_number, table_name, column_name) AS anchor",
    )
    measures = ["max(flag_rank) AS flag_rank", "min(row_number) AS row_number"]
    if with_anchor:
        measures.append("min(anchor) AS anchor")
    grouped = rows.groupBy(*KEY, "datatype", "change_type").agg(*map(F.expr, measures))

    # A dropped schema or database that holds no personal data is a No, whatever is Unknown.
    no_middle = in_list((DROPPED_DATABASE, DROPPED_SCHEMA, DROPPED_TABLE))
    is_pii = (
        f"CASE WHEN change_type = '{NEW_DATABASE}' THEN '{UNKNOWN}' "
        f"WHEN flag_rank = 2 THEN '{YES}' "
        f"WHEN flag_rank = 1 OR change_type IN {no_middle} THEN '{NO}' ELSE '{UNKNOWN}' END"
    )
    computed = {"severity": severity(), "action": action()}
    extra = ["anchor"] if with_anchor else []
    return grouped.withColumn("is_pii", F.expr(is_pii)).select(
        *[computed.get(c, c) for c in DRIFT], *extra
    )


def pii_bubble_up(keys: DataFrame) -> DataFrame:
    """Whether any column below a schema of the previous snapshot holds personal data."""
    return (
        keys.filter("prev IS NOT NULL")
        .groupBy(*KEY[:3])
        .agg(F.expr(f"IF(max(prev.is_pii = '{YES}'), '{YES}', '{NO}') AS has_pii"))
    )
