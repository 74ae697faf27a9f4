"""Reading snapshots whose connections share one layout: any Spark source or table."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, INVENTORY, DriftConfig
from catadrift.sources.positions import file_positions, sheet_positions

FORMATS = ("parquet", "csv", "json", "orc", "table")
# Standard name -> column of an inventory.
STANDARD_COLUMNS = {
    "Database": "db_name",
    "Schema": "schema_name",
    "Tables": "table_name",
    "Columns": "column_name",
    "Datatype": "datatype",
    "IsPII": "is_pii_raw",
}


@contextlib.contextmanager
def partition_values_as_text(spark: SparkSession) -> Iterator[None]:
    """Take names in folder paths as they are; with their types inferred, 007 and 7 would be one connection."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def resolve_headers(headers: list[str], config: DriftConfig = DEFAULT) -> dict[str, int]:
    """Position of the column of each standard name among the headers of one layout."""
    claimed: dict[int, str] = {}
    for name, pattern in config.header_patterns.items():
        match = next(
            (i for i, h in enumerate(headers) if re.search(pattern, h.strip().lower())), None
        )
        if match is not None and headers[match] != name:
            claimed[match] = name
    renamed = [claimed.get(i, h) for i, h in enumerate(headers)]
    bad = [name for name in config.header_patterns if renamed.count(name) != 1]
    if bad:
        raise ValueError(f"no single column for {', '.join(bad)} among headers {headers}")
    return {name: renamed.index(name) for name in config.header_patterns}


def standardise(
    df: DataFrame, connection: str | None = None, config: DriftConfig = DEFAULT
) -> DataFrame:
    """A source DataFrame as an inventory: standard columns found by header, all text; others in ``further``.

    ``row_number`` must be there; one that is no number becomes null. The connection is the ``connection`` column, such as that
    of a folder ``connection=...``, or the one given. Columns are taken by position, as
    Spark resolves names without regard to case.
    """
    inside = [c for c in df.columns if c not in ("connection", "row_number")]
    if set(STANDARD_COLUMNS.values()) <= set(inside):
        columns = {target: F.col(target) for target in STANDARD_COLUMNS.values()}
        other = {c: F.col(f"`{c}`") for c in inside if c not in columns}
    else:
        flat = df.toDF(*[
            c if c in ("connection", "row_number") else f"_{inside.index(c)}" for c in df.columns
        ])
        places = resolve_headers(inside, config)
        columns = {
            target: F.col(f"_{places[name]}") for name, target in STANDARD_COLUMNS.items()
        }
        used = set(places.values())
        other = {c: F.col(f"_{i}") for i, c in enumerate(inside) if i not in used}
        df = flat
    if connection is not None:
        df = df.withColumn("connection", F.lit(connection))
    elif "connection" not in df.columns:
        raise ValueError("name the connection, or give the source a connection column")
    if "row_number" not in df.columns:
        raise ValueError("the source has no row positions: give it a row_number column")
    further = [
        F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")) for name, value in other.items()
    ]
    return df.select(
        F.col("connection").cast("string").alias("connection"),
        *[value.cast("string").alias(target) for target, value in columns.items()],
        F.col("row_number").try_cast("long").alias("row_number"),
        (F.array(*further) if further else F.array().cast("array<struct<name:string,value:string>>")).alias("further"),
    ).select(*INVENTORY, "further")


def read_inventory(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    connection: str | None = None,
    config: DriftConfig = DEFAULT,
    **options: str,
) -> DataFrame:
    """Read a snapshot from files or a table.

    Files without a ``row_number`` get one: the place of each row among those of its connection, files in order of
    their paths, the header being row 1. A table must bring its own. JSON fields come in alphabetical order, which is
    then also the order of headers.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(FORMATS)}")
    if fmt == "table":
        df = spark.table(location)
    else:
        if fmt == "csv":
            options = {"header": "true", **options}
        with partition_values_as_text(spark):
            df = spark.read.format(fmt).options(**options).load(location)
    if fmt != "table" and "row_number" not in df.columns:
        df = _positioned(df, fmt, connection)
    return standardise(df, connection, config)


def _positioned(df: DataFrame, fmt: str, connection: str | None) -> DataFrame:
    """With ``row_number`` from the place of each row."""
    if connection is not None:
        df = df.withColumn("connection", F.lit(connection))
    elif "connection" not in df.columns:
        raise ValueError("name the connection, or give the source a connection column")
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if fmt == "parquet":
        one = df.select(file.alias("file")).first()
        if connection is not None or one is None or "/connection=" in one["file"]:
            return file_positions(df)  # a file holds one connection
        df = df.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_index"))
        return sheet_positions(df, ["_file", "_index"]).drop("_file", "_index")
    # rows of a block come in the order of the file
    df = df.select("*", file.alias("_file"), block.alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return sheet_positions(df, ["_file", "_block", "_line"]).drop("_file", "_block", "_line")
