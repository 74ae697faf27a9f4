"""Finding the standard columns of a sheet among headers of any spelling.

Headers come as rows ``(connection, pos, header)``, so all connections are resolved in one
job, whatever their number and however their headers differ. With a further column ``file``,
each file of a connection is a sheet with headers of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, DriftConfig
from catadrift.functions import strip


def _sheet(headers: DataFrame) -> list[str]:
    return ["connection", "file"] if "file" in headers.columns else ["connection"]


def header_map(headers: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """The header standing for each standard name: the first one its pattern occurs in.

    A name without such a header stands for itself (``pos`` is null).
    """
    text = F.lower(strip("header"))
    entry = F.struct("pos", F.col("header").alias("actual_name"))
    patterns = config.header_patterns
    found = headers.groupBy(*_sheet(headers)).agg(
        *[F.min(F.when(text.rlike(p), entry)).alias(name) for name, p in patterns.items()]
    )
    rows = [
        F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(name).alias("standard_name"),
            F.coalesce(F.col(f"{name}.actual_name"), F.lit(name)).alias("actual_name"),
            F.col(f"{name}.pos").alias("pos"),
        )
        for ord_, name in enumerate(patterns, 1)
    ]
    return found.select(*_sheet(headers), F.inline(F.array(*rows)))


def header_rename(headers: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """Every header with the name it gets.

    Where several standard names claim one header, the last of them has it; a header that is
    its standard name already needs no renaming and so claims nothing.
    """
    keys = _sheet(headers)
    claims = (
        header_map(headers, config)
        .filter("pos is not null and actual_name != standard_name")
        .groupBy(*keys, "pos")
        .agg(F.max(F.struct("ord", "standard_name")).alias("claim"))
        .select(*keys, "pos", F.col("claim.standard_name").alias("claimed"))
    )
    return headers.join(claims, [*keys, "pos"], "left").select(
        *keys, "pos", "header", F.coalesce("claimed", "header").alias("new_name")
    )


def _standard_counts(headers: DataFrame, config: DriftConfig) -> DataFrame:
    """Per sheet, how many columns bear each standard name after renaming."""
    return (
        header_rename(headers, config)
        .groupBy(*_sheet(headers))
        .agg(
            *[F.count_if(F.col("new_name") == name).alias(name) for name in config.header_patterns]
        )
    )


def header_conflicts(headers: DataFrame, config: DriftConfig = DEFAULT) -> DataFrame:
    """Standard names that no column, or more than one, bears after renaming."""
    rows = [
        F.struct(F.lit(name).alias("standard_name"), F.col(name).alias("n_columns"))
        for name in config.header_patterns
    ]
    kind = F.when(F.col("n_columns") == 0, "missing").otherwise("doubled")
    return (
        _standard_counts(headers, config)
        .select(*_sheet(headers), F.inline(F.array(*rows)))
        .filter("n_columns != 1")
        .withColumn("conflict", kind)
    )


def connection_status(
    prev_headers: DataFrame, curr_headers: DataFrame, config: DriftConfig = DEFAULT
) -> DataFrame:
    """Whether each connection on both sides can be compared, and why not."""

    def side(headers: DataFrame, name: str) -> DataFrame:
        counts = _standard_counts(headers, config).groupBy("connection").agg(*[
            F.struct(F.min(std).alias("low"), F.max(std).alias("high")).alias(std)
            for std in config.header_patterns
        ])
        return counts.select("connection", F.struct(*config.header_patterns).alias(name))

    def problems(name: str) -> list[Column]:
        return [
            F.when(F.col(f"{name}.{std}.low") == 0, f"{name} lacks {std}").when(
                F.col(f"{name}.{std}.high") > 1, f"{name} doubles {std}"
            )
            for std in config.header_patterns
        ]

    both = side(prev_headers, "prev").join(side(curr_headers, "curr"), "connection")
    reason = F.concat_ws("; ", *problems("prev"), *problems("curr"))
    return both.select(
        "connection",
        F.when(reason == "", "ok").otherwise("failed").alias("status"),
        reason.alias("reason"),
    )


def failed_connections(status: DataFrame) -> DataFrame:
    return status.filter("status = 'failed'").select("connection")


def has_database_header(headers: DataFrame) -> DataFrame:
    """Connections with a header that hints at a database."""
    text = F.lower(strip("header"))
    return headers.filter(text.contains("database") | text.contains("db")).select(
        "connection"
    ).distinct()
