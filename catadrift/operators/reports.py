"""Data sets of the reports, made from drift rows and the current snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catadrift.config import (
    DEFAULT,
    DEFAULT_TINT,
    DRIFT_FOUND,
    DROPPED_TYPES,
    HIGH,
    INVENTORY,
    KEY,
    NO_DRIFT,
    PARTIAL_RUN,
    DriftConfig,
)
from catadrift.functions import lookup, strip
from catadrift.operators.quality import group_by_key


def highlight(drift: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """Drift rows with the ARGB fill of their change type and flag, null for none."""
    return drift.withColumn("fill", lookup(config.highlights, "change_type", "is_pii"))


def annotate(
    curr: DataFrame, anchored_drift: DataFrame, config: DriftConfig = DEFAULT
) -> DataFrame:
    """The current snapshot as it was given, without duplicates, with the changes marked.

    Every connection is there, matched or not, and so are rows without a full key. Values
    are shown raw; duplicates and changes are found by the cleaned key. A new database marks
    the first row of each of its schemas.

    The snapshot is shuffled once, to remove duplicates. The marks are as few as the changes
    and have a row of their own each, so that joining them meets no hot key. Both aggregates
    leave their rows in the order of the hash and key, which the join takes as it is.
    """
    kept = [c for c in curr.columns if c not in ("connection", "row_number")]
    # the same type on both sides, nulls allowed
    whole = f"struct<{', '.join(f'{k}: string' for k in KEY)}>"
    cleaned = curr.select(
        F.struct(*[strip(k) for k in KEY]).cast(whole).alias("key"),
        F.struct("row_number", *kept).alias("row"),
    )
    first = group_by_key(cleaned, ["key"]).agg(F.min("row").alias("row"))
    marks = highlight(anchored_drift, config).filter("row_number IS NOT NULL").select(
        F.struct(
            *[F.col(k).alias(k) for k in KEY[:3]], F.col("anchor.table_name").alias(KEY[3]), F.col("anchor.column_name").alias(KEY[4])
        ).cast(whole).alias("key"),
        F.struct("change_type", "severity", "action", "fill").alias("mark"),
    )
    mark = group_by_key(marks, ["key"]).agg(F.min("mark").alias("mark"))
    # only a full key can have a mark
    annotated = first.join(mark, ["key_hash", "key"], "left")
    return annotated.select(
        F.col("key.connection").alias("connection"),
        *[f"row.{c}" for c in INVENTORY if c != "connection"],
        *[f"row.{c}" for c in kept if c not in INVENTORY],
        "mark.*",
    )


def dropped_section(drift: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """What the current snapshot no longer has, appended to its annotated copy."""
    return highlight(drift.filter(F.col("change_type").isin(*DROPPED_TYPES)), config).select(
        *KEY, "datatype", "is_pii", "change_type", "severity", "action", "fill"
    )


def annotated_report(annotated: DataFrame, dropped: DataFrame) -> DataFrame:
    """Annotated rows and dropped rows as one table, told apart by ``row_kind``."""
    below = dropped.withColumnRenamed("is_pii", "is_pii_raw").withColumn(
        "row_number", F.lit(None).cast("long")
    )
    return annotated.withColumn("row_kind", F.lit("inventory")).unionByName(
        below.withColumn("row_kind", F.lit("dropped")), allowMissingColumns=True
    )


def drift_sorted(drift: DataFrame) -> DataFrame:
    return drift.orderBy("connection", "change_type", *KEY[1:])


def critical_changes(drift: DataFrame) -> DataFrame:
    return drift.filter(F.col("severity") == HIGH).drop("row_number")


def critical_table(drift: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """Critical changes as the web report lists them, with the tint of each row."""
    tint = F.coalesce(lookup(config.tints, "change_type", "is_pii"), F.lit(DEFAULT_TINT))
    return critical_changes(drift).select(
        *KEY, "is_pii", "change_type", "severity", "action", tint.alias("tint")
    )


def drift_by_connection(drift: DataFrame) -> DataFrame:
    return drift.groupBy("connection", "change_type", "severity").agg(
        F.count("*").alias("n_changes")
    )


def severity_matrix(drift: DataFrame) -> DataFrame:
    """The severity and action that each change type and flag came with, and how often."""
    return drift.groupBy("change_type", "is_pii", "severity", "action").agg(
        F.count("*").alias("n_rows")
    )


def run_status(drift: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: drift rows, failed connections, and the status a pipeline acts on."""
    counts = drift.select(F.lit(1).alias("drift"), F.lit(0).alias("failed"))
    if failed is not None:
        counts = counts.unionByName(
            failed.select(F.lit(0).alias("drift"), F.lit(1).alias("failed"))
        )
    total = counts.agg(
        F.coalesce(F.sum("drift"), F.lit(0)).cast("long").alias("drift_rows"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed_connections"),
    )
    status = (
        F.when(F.col("failed_connections") > 0, PARTIAL_RUN)
        .when(F.col("drift_rows") > 0, DRIFT_FOUND)
        .otherwise(NO_DRIFT)
    )
    return total.withColumn("status", status)

