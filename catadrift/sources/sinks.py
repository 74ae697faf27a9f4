"""Writing the results of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_by_connection(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write one folder per connection.

    The rebalance gathers a connection's rows into files of good size and, unlike a
    repartition by connection, splits a connection that is too large for one task. Without any
    row there is no folder to tell the schema, so an empty file does.
    """
    if df.isEmpty():
        write_plain(df.limit(0).coalesce(1), path, fmt)
        return
    (
        df.hint("rebalance", "connection")
        .write.mode("overwrite")
        .partitionBy("connection")
        .format(fmt)
        .save(path)
    )


def write_plain(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a summary or one row per connection."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_files(texts: DataFrame, keys: list[str], path: str, name: str) -> None:
    """Write each row's ``value``, and a line break, to a file of the given name in a folder per key, in place of what is there."""
    texts.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)
    jvm, session = texts.sparkSession._jvm, texts.sparkSession._jsparkSession
    written = jvm.org.apache.hadoop.fs.Path(path + "/*" * len(keys) + "/part-*")
    store = written.getFileSystem(session.sessionState().newHadoopConf())
    for file in store.globStatus(written) or []:  # only names change here
        store.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(file.getPath().getParent(), name))
