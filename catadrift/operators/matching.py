"""Matching the two sides: by full key, and by name at each level of the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, KEY, TABLE_KEY, DriftConfig
from catadrift.functions import strip
from catadrift.operators.quality import clean, complete_rows, group_by_key
from catadrift.plans.session import join_salted

# Level names with the number of key columns that identify a member of the level.
LEVELS = {"connection": 1, "database": 2, "schema": 3, "table": 4, "column": 5}


def level_key(level: str) -> list[str]:
    return KEY[: LEVELS[level]]


def both_sides(prev: DataFrame, curr: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """Both snapshots, cleaned but with duplicates, as one tagged DataFrame of keyed rows."""

    def side(df: DataFrame, is_prev: bool) -> DataFrame:
        # Stripping leaves nulls null, so incomplete rows can go before it costs anything.
        # Key parts are then declared not null: otherwise each join below would derive a null
        # filter of its own and push it to the source, and no two branches of a plan would
        # share a scan and shuffle any more.
        rows = clean(complete_rows(df), "strip", config)
        not_null = [f"coalesce({k}, '') AS {k}" for k in KEY]
        return rows.selectExpr(*not_null, "datatype", "is_pii", "row_number", f"{is_prev} AS is_prev")

    return side(prev, True).unionByName(side(curr, False))


def match_keys(sides: DataFrame) -> DataFrame:
    """One row per key with its first row on either side, null where the side lacks it.

    Deduplication and the full outer join of the sides are one aggregate, hence one shuffle.
    """
    first = "min(struct(row_number, datatype, is_pii)) FILTER (WHERE {})"
    return group_by_key(sides).agg(
        F.expr(first.format("is_prev")).alias("prev"),
        F.expr(first.format("NOT is_prev")).alias("curr"),
    ).drop("key_hash")


def hierarchy(sides: DataFrame) -> dict[str, DataFrame]:
    """Names at every level above the column: the sides they are on and what is missing.

    ``missing`` is the highest level at which the name or one of its ancestors is on one
    side only, and null where the name and all its ancestors are on both.

    Tables are found in the raw rows: a catalog lists the columns of a table together, so
    the map side reduces them to about one row per table before anything is shuffled. Each
    higher level aggregates the level below. Every aggregate is a flag per group, which a
    group of any size reduces to before the shuffle.
    """
    seen = {
        "table": sides.groupBy(*level_key("table")).agg(
            F.expr("max(is_prev) AS in_prev"), F.expr("max(NOT is_prev) AS in_curr")
        )
    }
    for lower, level in (("table", "schema"), ("schema", "database"), ("database", "connection")):
        seen[level] = seen[lower].groupBy(*level_key(level)).agg(
            F.expr("max(in_prev) AS in_prev"), F.expr("max(in_curr) AS in_curr")
        )

    names = {}
    parent = None
    for level in ("connection", "database", "schema", "table"):
        own = f"IF(in_prev != in_curr, '{level}', NULL)"
        if parent is None:
            names[level] = seen[level].withColumn("missing", F.expr(own))
        else:
            # Names on both sides have all their ancestors on both sides, so the parents
            # worth joining are the few that are missing somewhere.
            gone = names[parent].filter("missing is not null").select(
                *level_key(parent), F.col("missing").alias("parent_missing")
            )
            names[level] = (
                join_salted(seen[level], gone, level_key(parent), level_key(level)[-1])
                .select(
                    *level_key(level), "in_prev", "in_curr",
                    F.expr(f"coalesce(parent_missing, {own}) AS missing"),
                )
            )
        parent = level
    return names


def gone_tables(names: dict[str, DataFrame]) -> DataFrame:
    """Tables that are missing on one side, themselves or through an ancestor."""
    return names["table"].filter("missing is not null").select(*TABLE_KEY, "missing")


def presence(keys: DataFrame, names: dict[str, DataFrame]) -> DataFrame:
    """Every key with the sides it is on and the highest level at which it is missing.

    A key on both sides misses nothing, so only one-sided keys are joined to the tables.
    """
    flags = keys.selectExpr("*", "prev IS NOT NULL AS in_prev", "curr IS NOT NULL AS in_curr")
    common = flags.filter("in_prev and in_curr").selectExpr("*", "CAST(NULL AS STRING) AS missing")
    one_sided = join_salted(
        flags.filter("in_prev != in_curr"), gone_tables(names), TABLE_KEY, "column_name"
    ).withColumn("missing", F.expr("coalesce(missing, 'column')"))
    return common.unionByName(one_sided)


def names_by_change(
    keys: DataFrame, names: dict[str, DataFrame], level: str, change: str
) -> DataFrame:
    """Names of a level that are new, dropped or common, inside parents that are common."""
    rows = presence(keys, names) if level == "column" else names[level]
    condition = {
        "new": (F.col("missing") == level) & F.col("in_curr"),
        "dropped": (F.col("missing") == level) & F.col("in_prev"),
        "common": F.col("missing").isNull(),
    }[change]
    return rows.filter(condition).select(*level_key(level))


def connections(df: DataFrame) -> DataFrame:
    """Distinct stripped connections of a snapshot."""
    return df.select(strip("connection")).distinct()


def connection_sides(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Every connection and the sides it is on, null names left out."""
    tagged = connections(prev).withColumn("is_prev", F.lit(True)).unionByName(
        connections(curr).withColumn("is_prev", F.lit(False))
    )
    return tagged.filter("connection is not null").groupBy("connection").agg(
        F.max("is_prev").alias("in_prev"), F.max(~F.col("is_prev")).alias("in_curr")
    )


def common_connections(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return connection_sides(prev, curr).filter("in_prev and in_curr").select("connection")


def unmatched_connections(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Connections on one side only; the comparison leaves them out without a change row."""
    side = F.when(F.col("in_prev"), "prev").otherwise("curr")
    return (
        connection_sides(prev, curr)
        .filter("in_prev != in_curr")
        .select("connection", side.alias("side"))
    )
