"""Small helpers for DataFrames that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside packed arrays; sorts before every other id.
NO_ID = -(1 << 63)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which follow the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(df: DataFrame, name: str, count: int, *keys: str) -> DataFrame:
    """Deal the rows by a hash of the keys; an equal key is in an equal block wherever and whenever it is worked out."""
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(count)).cast("int"))


def checkpoint_folder(spark: SparkSession) -> None:
    """Name a folder for checkpoints where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def packed(shard: np.ndarray, **arrays: np.ndarray) -> dict[str, list]:
    """One row for each shard that occurs: its number, and for each array the bytes of the shard's elements in order."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    out: dict[str, list] = {"shard": shard[cut].tolist()}
    edges = np.r_[cut, len(shard)]
    for name, values in arrays.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of packed arrays, and how many each row has."""
    rows = column.to_pylist()
    parts = [np.frombuffer(x, dtype) for x in rows]
    lengths = np.array([len(x) for x in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), lengths


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as integers, nulls as NO_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))


def scratch(spark: SparkSession, stem: str) -> str:
    """A path for a written table that doesn't exist yet, in the folder that all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4().hex}"


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Write the rows to the shared folder and read them again."""
    path = scratch(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bits of a field that lets rows pass whose key may be among wanted ones: 64 KB, whatever their number.
FIELD_BITS = 1 << 19


def bit_field(wanted: DataFrame, key: str) -> np.ndarray:
    """The bits of all wanted keys. At most FIELD_BITS / 64 rows reach the driver."""
    bit = F.pmod(F.xxhash64(key), F.lit(FIELD_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("CAST(bit div 64 AS INT)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")
    )
    field = np.zeros(FIELD_BITS // 64, np.int64)
    for row in words.collect():
        field[row.word] = row.bits
    return field


def may_hold(field: np.ndarray, key: str) -> Column:
    """Whether the key's bit is set: true for all wanted keys and a few others."""
    bit = F.pmod(F.xxhash64(key), F.lit(FIELD_BITS))
    return F.getbit(F.get(F.lit(field), F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1
