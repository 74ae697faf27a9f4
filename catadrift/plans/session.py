"""What the library needs of a session: settings, a checkpoint folder, joins that split hot groups."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input per split and per shuffle partition.
PARTITION_BYTES = 512 << 20
#: Whether an execution's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Facts of up to so many bytes of text are sent to all tasks.
SMALL_FACTS = 32 << 20
#: Folders that cut() has written.
CUTS: list[str] = []


def tuning(input_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Session settings for snapshots of a given total size.

    Splits and shuffle partitions have ``partition_bytes`` at every size, half a gigabyte unless told otherwise, which
    suits an executor core. Adaptive execution merges partitions that turn out small and splits those of a hot join
    key. Methods too long for the JVM's compiler are not fused, since it would run them interpreted.
    """
    partitions = max(8, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }


def tune(spark: SparkSession, input_bytes: int) -> None:
    """Set what ``tuning`` says; the command line and the bench both run under these settings."""
    for key, value in tuning(input_bytes).items():
        spark.conf.set(key, value)


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Total size of the files below the paths; their contents are not read."""
    files = [spark.read.format("binaryFile").load(p).select("length") for p in paths]
    return sum(f.agg(F.sum("length")).first()[0] or 0 for f in files)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; a local session without one gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    context.setCheckpointDir(folder)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files; otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the checkpoint folder, where it outlives lost executors.

    As compressed columns it takes far less disk than the rows of Spark's own checkpoints.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cuts_removed(spark: SparkSession) -> Iterator[None]:
    """What is cut meanwhile is deleted at the end."""
    kept = len(CUTS)
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, CUTS[kept:]):
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        del CUTS[kept:]


def salts(spark: SparkSession) -> int:
    """Pieces that every group of a salted join is cut into, and copies that every fact gets.

    The square root of the number of shuffle partitions: both the largest piece and the copies
    grow far slower than the data.
    """
    return max(8, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_salted(
    rows: DataFrame, groups: DataFrame, on: list[str], salt_from: str, how: str = "left"
) -> DataFrame:
    """Join rows with facts on their group, of which ``groups`` has one row each.

    A group may hold a large share of the rows, so the rows are cut into pieces by a hash of
    ``salt_from`` and every piece gets a copy of the fact. The copies also give the join a
    shuffle on either side, which is what adaptive execution needs to split a piece that is
    still too large; where the facts turn out small it broadcasts them instead.

    The key is joined as one struct. Joined column by column, snapshots partitioned by
    connection would get a dynamic partition filter in one branch of the plan and not in the
    others, and those would no longer share their scans and shuffles. A hash of it leads: a sort
    has no short prefix for a struct and would compare names that start alike part by part.
    ``on`` must have the same types on both sides.
    """
    pieces = salts(rows.sparkSession)
    names = ", ".join(on)
    key = [f"xxhash64({names}, salt) AS join_hash", f"struct({names}, salt) AS join_key"]
    facts = groups.selectExpr("*", f"explode(sequence(0, {pieces - 1})) AS salt").selectExpr(
        *key, *[c for c in groups.columns if c not in on]
    )
    salted = rows.selectExpr("*", f"CAST(pmod(xxhash64({salt_from}), {pieces}) AS INT) AS salt")
    joined = salted.selectExpr(*rows.columns, *key).join(facts, ["join_hash", "join_key"], how)
    return joined.drop("join_hash", "join_key")


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], salt_from: str, how: str = "left") -> DataFrame:
    """Join rows with facts on their group, of which ``facts`` has one row each and is computed first.

    Facts that turn out small are sent to all tasks, and the rows stay where they are. Adaptive execution would do so too,
    but only after it has shuffled the rows.
    """
    facts = cut(facts)
    size = facts.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size > SMALL_FACTS:
        return join_salted(rows, facts, on, salt_from, how)
    key = f"struct({', '.join(on)}) AS join_key"
    small = F.broadcast(facts.selectExpr(key, *[c for c in facts.columns if c not in on]))
    return rows.selectExpr("*", key).join(small, "join_key", how).drop("join_key")
