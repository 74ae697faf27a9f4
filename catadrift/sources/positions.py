"""Row positions: where a row stands in its connection's sheet, the header being row 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catadrift.plans.session import cut, join_facts, join_salted

# Rows of a partition are numbered in the low bits of monotonically_increasing_id.
_IN_PARTITION = (1 << 33) - 1


def file_positions(df: DataFrame) -> DataFrame:
    """Add ``row_number`` to a Parquet DataFrame in whose files a single connection lies each.

    Rows keep the order of their file, files that of their paths. Nothing but one row per file
    is shuffled.
    """
    placed = df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_index": F.col("_metadata.row_index"),
            # Joins do not match nulls, and a row without a connection must not get lost.
            "_sheet": F.coalesce("connection", F.lit("")),
        }
    )
    files = placed.groupBy("_sheet", "_file").agg(
        F.min("_index").alias("_start"), (F.max("_index") - F.min("_index") + 1).alias("_span")
    )
    # As many rows as there are files of a connection.
    before = W.partitionBy("_sheet").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.select(
        "_sheet",
        "_file",
        (F.coalesce(F.sum("_span").over(before), F.lit(0)) - F.col("_start") + 2).alias("_shift"),
    )
    return (
        join_salted(placed, offsets, ["_sheet", "_file"], "_index", "inner")
        .withColumn("row_number", F.col("_index") + F.col("_shift"))
        .drop("_sheet", "_file", "_index", "_shift")
    )


def sheet_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``row_number``: the dense place of each row in its connection, by ``order``."""
    return placed_rows(df, order)[0]


def placed_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``row_number``, their dense place in their connection by ``order``, and the places that are taken.

    A ranking by window would put a whole connection into one task. Here rows are range
    partitioned by connection and order, so a connection of any size spreads over as many
    partitions as it needs; rows are numbered inside their partition, and the few counts per
    partition and connection give what to add. ``order``, columns or expressions, must be
    unique in a connection.

    The numbered rows are cut off before their counts are taken: the boundaries of a range
    partitioning are sampled, so a second run of it need not repeat them.

    The places taken are ranges: connection, first, last.
    """
    by = [F.expr(x) for x in ("connection", *order)]
    numbered = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_index": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)),
            }
        )
    )
    pieces = numbered.groupBy("_part", "connection").agg(
        F.min("_index").alias("_start"), F.count("*").alias("_rows")
    )
    # A connection has at most one piece per partition; an empty name goes on where rows without one end.
    before = W.partitionBy(F.coalesce("connection", F.lit(""))).orderBy("_part", "_start").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start") + 2)
    rows = (
        join_facts(numbered, shifts.select("_part", "connection", "_shift"), ["_part", "connection"], "_index", "inner")
        .withColumn("row_number", F.col("_index") + F.col("_shift"))
        .drop("_part", "_index", "_shift")
    )
    first = F.col("_start") + F.col("_shift")
    return rows, shifts.select("connection", first.alias("first"), (first + F.col("_rows") - 1).alias("last"))
