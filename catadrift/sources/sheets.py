"""Reading snapshots in which every sheet has headers of its own.

A sheet is a CSV file in a folder ``connection=<name>``; its first record is the header, all others are rows. Records may
be of any width and hold quoted line breaks. A row stands at its place among the rows of its connection, files in order
of their paths, the header being row 1. Further columns without a header, and cells beyond it, are named by their place
("Unnamed: 6", counted from 0). Which cell is which column is data, resolved for all files at once.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, INVENTORY, DriftConfig
from catadrift.functions import strip
from catadrift.operators.headers import header_conflicts, header_rename
from catadrift.plans.session import cut, join_facts, join_salted
from catadrift.sources.inventory import STANDARD_COLUMNS, partition_values_as_text

RECORDS = "connection STRING, file STRING, index BIGINT, cells ARRAY<STRING>"
#: Records of a block of a file; open if the record goes on in the next block. Of a count, index is the number of records.
BLOCKS = "connection STRING, file STRING, block BIGINT, index BIGINT, cells ARRAY<STRING>, open BOOLEAN"
BATCH = 10_000
#: What is taken of a block.
HEADER, ROWS, COUNT = "header", "rows", "count"


def records_batch(connection: str, file: str, index: Iterable[int], cells: list[list] | pa.ListArray) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(connection, pa.string()), n), pa.repeat(pa.scalar(file, pa.string()), n),
            pa.array(index, pa.int64()), cells if isinstance(cells, pa.ListArray) else pa.array(cells, pa.list_(pa.string())),
        ],
        names=["connection", "file", "index", "cells"],
    )


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the file or the block changes, with connection, file, block and size."""
    for batch in batches:
        if batch.num_rows:
            file, block = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
            ends = [*(np.flatnonzero(np.diff(file) | np.diff(block)) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends], ends):
                yield tuple(c[start].as_py() for c in batch.columns[:4]), batch.slice(start, end - start)


class _Feed:
    """Lines for a parser, which asks for more than there are if the last record is open.

    Spark's lines don't tell whether the last one of a file ends with a line break, which counts inside quotes only. Of a whole
    file, the size does; a byte order mark, which isn't in the lines, has three bytes.
    """

    def __init__(self, lines: Iterator[bytes], size: int | None) -> None:
        self.lines, self.size, self.ended = lines, size, False

    def __iter__(self) -> Iterator[str]:
        read, line = 0, next(self.lines)
        while line is not None:
            after = next(self.lines, None)
            read += len(line) + 1
            broken = after is not None or self.size is None or read in (self.size, self.size - 3)
            text = line.decode("utf-8", "replace") + ("\n" if broken else "")
            if "\r" in text:
                yield from io.StringIO(text, newline="")
            else:
                yield text
            line = after
        self.ended = True


def _parse(taken: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for (connection, file, block, size), lots in itertools.groupby(_lots(batches), itemgetter(0)):

            def batch(index: Iterable[int], cells: list, is_open: bool) -> pa.RecordBatch:
                n = len(cells)
                columns = [pa.repeat(pa.scalar(x, t), n) for x, t in ((connection, pa.string()), (file, pa.string()), (block, pa.int64()))]
                columns += [pa.array(index, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.repeat(pa.scalar(is_open), n)]
                return pa.RecordBatch.from_arrays(columns, names=["connection", "file", "block", "index", "cells", "open"])

            feed = _Feed((line for _, lot in lots for line in lot.column("line").to_pylist()), size)
            n, held, is_open = 0, [], False
            # lines keep their breaks, for those inside quotes
            for record in csv.reader(feed):
                if not record:
                    continue
                n += 1
                is_open = feed.ended
                if taken != COUNT:
                    held.append([cell or None for cell in record])
                if taken == HEADER:
                    break
                if len(held) == BATCH:
                    yield batch(range(n - BATCH, n), held, is_open)
                    held = []
            if taken == COUNT:
                yield batch([n], [None], is_open)
            elif held:
                yield batch(range(n - len(held), n), held, is_open)

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files: connection, file, block, size, line. Those of a block, the part of a file that a task reads, come in order."""
    with partition_values_as_text(spark):
        # the text source reads a file piece by piece and splits it at any line
        files = spark.read.format("text").option("pathGlobFilter", "*.csv").option("lineSep", "\n").load(path)
    if "connection" not in files.columns:
        raise ValueError(f"no folders connection=<name> below {path}")
    return files.select(
        "connection", F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.lit(None).cast("long").alias("size"), F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def _parsed(lines: DataFrame, taken: str) -> DataFrame:
    return lines.drop("file_size").mapInArrow(_parse(taken), BLOCKS)


def _whole(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the files whose records go beyond a block, each file as one block: sorted, and read line by line."""
    placed = lines.withColumn("place", F.monotonically_increasing_id()).join(files, "file", "left_semi")
    return placed.repartition("file").sortWithinPartitions("file", "block", "place").select(
        "connection", "file", F.lit(0).cast("long").alias("block"), F.col("file_size").alias("size"), "line", "file_size"
    )


def csv_sheet_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all sheets: connection, file, pos, header (null if blank). Only the first record of a block is parsed."""
    lines = _lines(spark, path)
    first = F.min_by(F.struct("connection", "cells", "open"), "block").alias("first")
    found = cut(_parsed(lines, HEADER).groupBy("file").agg(first).select("file", "first.*"))
    beyond = found.filter("open").select("file")
    if not beyond.isEmpty():
        found = found.filter("NOT open").unionByName(_parsed(_whole(lines, beyond), HEADER), allowMissingColumns=True)
    return found.select("connection", "file", F.posexplode("cells").alias("pos", "header"))


def csv_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets: connection, file, row_number, cells.

    A block is parsed as if a record began at its start, which holds for all blocks of a file in which no record is open at
    the end of a block. Other files are parsed from their start.
    """
    lines = _lines(spark, path)
    blocks = cut(_parsed(lines, COUNT)).drop("cells")
    beyond = blocks.filter("open").select("file").distinct()
    records = _parsed(lines, ROWS)
    if not beyond.isEmpty():
        whole = _whole(lines, beyond)
        blocks = blocks.join(beyond, "file", "left_anti").unionByName(_parsed(whole, COUNT).drop("cells"))
        records = records.join(beyond, "file", "left_anti").unionByName(_parsed(whole, ROWS))
    # One row per block of a file.
    in_file = W.partitionBy("file").orderBy("block")
    in_connection = W.partitionBy("connection").orderBy("file", "block")
    places = blocks.filter("index > 0").withColumn("above", F.sum("index").over(in_file) - F.col("index"))
    headers = F.sum(F.when(F.col("above") == 0, 1).otherwise(0)).over(in_connection)
    places = places.select(
        "file", "block", "above", (F.sum("index").over(in_connection) - F.col("index") - headers + 2).alias("shift")
    )
    return join_facts(records, places, ["file", "block"], "index", "inner").filter("index + above > 0").select(
        "connection", "file", (F.col("index") + F.col("shift")).alias("row_number"), "cells"
    )


def numbered(records: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Rows below the headers, each with its place among those of its connection, files in order of their paths.

    ``last`` has the last record of each file, where a pass of its own tells it without cells.
    """
    # One row per file of a connection.
    before = W.partitionBy("connection").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = (records if last is None else last).filter("index > 0").groupBy("connection", "file").agg(F.max("index").alias("n"))
    shifts = files.select(
        "connection", "file", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("shift")
    )
    return join_facts(records.filter("index > 0"), shifts, ["connection", "file"], "index", "inner").select(
        "connection", "file", (F.col("index") + F.col("shift")).alias("row_number"), "cells"
    )


def _unnamed(pos: Column) -> Column:
    return F.concat(F.lit("Unnamed: "), pos.cast("string"))


def sheet_inventory(
    sheets: DataFrame, headers: DataFrame, config: DriftConfig = DEFAULT
) -> DataFrame:
    """Sheets as one inventory, further columns in ``further``.

    Connections with header conflicts in any of their sheets are left out whole. Without a ``file`` column, a
    connection is one sheet.
    """
    headers = headers.withColumn("connection", strip("connection"))
    keys = [c for c in ("connection", "file") if c in headers.columns]
    renamed = header_rename(headers, config)
    other = F.col("new_name").isNull() | ~F.col("new_name").isin(*STANDARD_COLUMNS)
    named = F.coalesce("header", _unnamed(F.col("pos"))).alias("header")
    places = (
        renamed.groupBy(*keys)
        .agg(
            *[
                F.min(F.when(F.col("new_name") == name, F.col("pos"))).alias(target)
                for name, target in STANDARD_COLUMNS.items()
            ],
            F.array_sort(F.collect_list(F.when(other, F.struct("pos", named)))).alias("other"),
            (F.max("pos") + 1).alias("width"),
        )
        .join(header_conflicts(headers, config).select("connection").distinct(), "connection", "left_anti")
        .select(*keys, F.struct(*STANDARD_COLUMNS.values(), "other", "width").alias("place"))
    )
    join = join_facts if "file" in keys else join_salted
    rows = join(
        sheets.withColumn("connection", strip("connection")), places, keys, "row_number", "inner"
    )
    further = F.transform(
        "place.other", lambda x: F.struct(x.header.alias("name"), F.get("cells", x.pos).alias("value"))
    )
    beyond = F.transform(
        F.slice("cells", F.col("place.width") + 1, F.size("cells")),
        lambda x, i: F.struct(_unnamed(i + F.col("place.width")).alias("name"), x.alias("value")),
    )
    further = F.concat(further, F.filter(beyond, lambda x: x.value.isNotNull()))
    return rows.select(
        "connection",
        *[F.get("cells", F.col(f"place.{c}")).alias(c) for c in STANDARD_COLUMNS.values()],
        "row_number",
        further.alias("further"),
    ).select(*INVENTORY, "further")
