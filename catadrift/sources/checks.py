"""Checks of the two inputs, made before a comparison."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catadrift.functions import strip
from catadrift.operators.headers import has_database_header
from catadrift.operators.matching import common_connections


def check_locations(previous: str, current: str, fmt: str) -> None:
    """Reject a comparison of a snapshot with itself."""

    def resolved(location: str) -> str:
        remote = fmt == "table" or "://" in location
        return location.rstrip("/") if remote else os.path.abspath(location)

    if resolved(previous) == resolved(current):
        raise ValueError(f"previous and current snapshot are the same: {previous}")


def snapshot_checks(prev: DataFrame, curr: DataFrame, prev_headers: DataFrame) -> DataFrame:
    """One row: common connections, those with a database header before, and the verdict."""
    common = common_connections(prev, curr)
    headers = prev_headers.withColumn("connection", strip("connection"))
    valid = has_database_header(headers).withColumn("valid", F.lit(1))
    return (
        common.join(valid, "connection", "left")
        .agg(F.count("*").alias("common_connections"), F.count("valid").alias("valid_connections"))
        .withColumn("passed", F.col("valid_connections") > 0)
    )


def check_connections(prev: DataFrame, curr: DataFrame) -> None:
    """Reject snapshots without a connection in common."""
    if common_connections(prev, curr).isEmpty():
        raise ValueError("the snapshots have no connection in common")


def check_headers(prev: DataFrame, curr: DataFrame, prev_headers: DataFrame) -> None:
    """Reject snapshots none of whose common connections has a database header before."""
    if not snapshot_checks(prev, curr, prev_headers).first()["passed"]:
        raise ValueError("no common connection of the previous snapshot has a database header")
