"""Cleaning a snapshot: whitespace, flag spelling, duplicates, rows that cannot be keyed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, KEY, DriftConfig
from catadrift.functions import normalise_pii, strip

MODES = ("all", "strip", "dedup")


def strip_columns(df: DataFrame) -> DataFrame:
    """Strip every text column of a snapshot."""
    return df.select(*[strip(name) if kind == "string" else name for name, kind in df.dtypes])


def add_pii_flag(
    df: DataFrame, config: DriftConfig = DEFAULT, stripped: bool = False
) -> DataFrame:
    """Add ``is_pii`` (Yes, No, Unknown) next to the raw flag."""
    return df.withColumn("is_pii", normalise_pii("is_pii_raw", config, stripped))


def group_by_key(df: DataFrame, keys: list[str] = KEY) -> GroupedData:
    """Group rows by key, sorted by a hash of it.

    The first row of a key holds text, so its aggregate sorts. Names under one connection and
    database start alike, and every comparison would walk through several of them; led by a
    hash, nearly all end at the first eight bytes.
    """
    return df.withColumn("key_hash", F.xxhash64(*keys)).groupBy("key_hash", *keys)


def dedup_first(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Keep the row with the smallest position of each key; null key parts equal each other.

    ``min`` over a struct led by the position combines on the map side, so a key with very
    many copies shrinks to one row per task before the shuffle. Should two copies share a
    position, the rest of the struct decides, and the survivor is still the same every run.
    """
    rest = [c for c in df.columns if c not in (*keys, "row_number")]
    first = group_by_key(df, keys).agg(F.min(F.struct("row_number", *rest)).alias("first"))
    return first.select(*keys, "first.*").select(*df.columns)


def clean(df: DataFrame, mode: str = "all", config: DriftConfig = DEFAULT) -> DataFrame:
    """Clean a snapshot.

    ``all`` strips, normalises the flag and removes duplicates; ``strip`` leaves duplicates;
    ``dedup`` removes duplicates on the raw values and changes nothing else.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode != "dedup":
        df = add_pii_flag(strip_columns(df), config, stripped=True)
    if mode != "strip":
        df = dedup_first(df)
    return df


def duplicates(df: DataFrame) -> DataFrame:
    """The rows that :func:`dedup_first` removes, with how often each was there.

    Only keys with more than one row find a partner in the join. The copies of a key need no
    order among themselves, so adaptive execution may split a key that has very many.
    """
    content = ["row_number", *[c for c in df.columns if c not in (*KEY, "row_number")]]
    kept = (
        df.groupBy(*KEY)
        .agg(F.min(F.struct(*content)).alias("kept"), F.count("*").alias("n_rows"))
        .filter("n_rows > 1")
        .select(*[F.col(k).alias(f"kept_{k}") for k in KEY], "kept")
    )
    same_key = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"kept_{k}")) for k in KEY]
    )
    is_kept = F.struct(*content).eqNullSafe(F.col("kept")).alias("is_kept")
    return (
        df.join(kept, same_key)
        .select(*df.columns, is_kept)
        .groupBy(*df.columns, "is_kept")
        .agg(F.count("*").alias("n_rows"))
        .selectExpr(*df.columns, "n_rows - IF(is_kept, 1, 0) AS n_removed")
        .filter("n_removed > 0")
    )


HAS_NULL_KEY = " OR ".join(f"{k} IS NULL" for k in KEY)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows whose key has no null part: the only ones that can be compared."""
    return df.filter(f"NOT ({HAS_NULL_KEY})")


def rejected_rows(df: DataFrame) -> DataFrame:
    """Rows set aside because a key part is null, with the parts that are missing."""
    missing = ", ".join(f"IF({k} IS NULL, '{k}', NULL)" for k in KEY)
    reason = F.expr(f"concat('null ', concat_ws(', ', {missing}))")
    return df.filter(HAS_NULL_KEY).withColumn("reason", reason)
