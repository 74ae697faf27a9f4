"""Reading, checking and writing snapshots."""

import csv
import io

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catadrift import Comparison, compare, compare_locations, compare_sheets, read_inventory
from catadrift.__main__ import run
from catadrift.config import INVENTORY
from catadrift.operators import headers
from catadrift.operators.matching import unmatched_connections
from catadrift.plans import registry
from catadrift.sources import checks, positions, sheets, sinks
from tests.snapshots import CURRENT, PREVIOUS, frame, golden_pair, rows

HEADER = ["row", "Database", "SchemaName", "tbl", "field", "DATA_TYPE", "Sensitive"]


def write_golden(spark, tmp_path, fmt="parquet"):
    paths = []
    for name, df in zip(("prev", "curr"), golden_pair(spark), strict=True):
        path = str(tmp_path / name)
        writer = df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
        writer.option("ignoreTrailingWhiteSpace", False).format(fmt).save(path)
        paths.append(path)
    return paths


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_formats(spark, tmp_path, fmt):
    prev, curr = write_golden(spark, tmp_path, fmt)
    found = read_inventory(spark, prev, fmt)
    assert found.columns == [*INVENTORY, "further"]
    found = found.select(*INVENTORY)
    assert found.exceptAll(golden_pair(spark)[0]).isEmpty()
    assert compare_locations(spark, prev, curr, fmt).drift.count() == 17


def test_table(spark):
    golden_pair(spark)[0].createOrReplaceTempView("audit_before")
    assert read_inventory(spark, "audit_before", "table").count() == 15


def test_headers_are_found_in_a_shared_layout(spark, tmp_path):
    path = str(tmp_path / "x")
    names = ["connection", *HEADER[1:], "row_number"]
    frame(spark, rows(PREVIOUS)).toDF(*names).write.parquet(path)
    assert read_inventory(spark, path).select(*INVENTORY).exceptAll(frame(spark, rows(PREVIOUS))).isEmpty()


def test_names_that_differ_only_in_case(spark):
    df = spark.createDataFrame(
        [("C", "d", "s", "t", "c", "INT", "y", "x", 2)],
        ["connection", "Database", "Schema", "Tables", "Columns", "Datatype", "IsPII", "DATABASE_", "row_number"],
    )
    from catadrift.sources.inventory import standardise

    assert standardise(df).first().db_name == "d"


def test_positions_of_parquet_rows(spark, tmp_path):
    """Several files per connection, several connections, some without positions."""
    path = str(tmp_path / "x")
    data = spark.range(1000).selectExpr(
        "IF(id < 600, 'A', 'B') AS connection", "'d' AS db_name", "'s' AS schema_name",
        "'t' AS table_name", "concat('c', id) AS column_name", "'INT' AS datatype", "'y' AS is_pii_raw",
    )
    data.repartitionByRange(4, "connection", "column_name").write.partitionBy("connection").parquet(path)
    found = read_inventory(spark, path)
    for connection, n in (("A", 600), ("B", 400)):
        numbers = [r.row_number for r in found.filter(F.col("connection") == connection).collect()]
        assert sorted(numbers) == list(range(2, n + 2))


def test_one_parquet_sheet_is_numbered_like_a_sheet(spark, tmp_path):
    path = str(tmp_path / "x")
    frame(spark, rows(CURRENT)).drop("row_number", "connection").coalesce(1).write.parquet(path)
    found = read_inventory(spark, path, connection="CRM")
    assert found.select(*INVENTORY).exceptAll(frame(spark, rows(CURRENT))).isEmpty()


def test_connections_that_lie_mixed_in_a_file(spark, tmp_path):
    path = str(tmp_path / "x")
    data = [("AB"[i % 2], "d", "s", "t", f"c{i}", "INT", "y") for i in range(6)]
    names = [c for c in INVENTORY if c != "row_number"]
    spark.createDataFrame(data, names).coalesce(1).write.parquet(path)
    found = {(r.connection, r.column_name): r.row_number for r in read_inventory(spark, path).collect()}
    assert found == {("AB"[i % 2], f"c{i}"): 2 + i // 2 for i in range(6)}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_connection_names_stay_text(spark, tmp_path, fmt):
    path = tmp_path / "x"
    for name in ("007", "7", "1.50"):
        one = frame(spark, rows(PREVIOUS)).drop("connection").coalesce(1)
        one.write.option("header", True).format(fmt).save(str(path / f"connection={name}"))
    found = read_inventory(spark, str(path), fmt)
    assert {r.connection for r in found.select("connection").distinct().collect()} == {"007", "7", "1.50"}


def test_sheet_positions_keep_rows_without_connection(spark):
    df = spark.range(300).selectExpr("IF(id % 3 = 0, NULL, concat('c', id % 3)) AS connection", "id")
    found = positions.sheet_positions(df, ["id"]).collect()
    assert len(found) == 300
    for connection in (None, "c1", "c2"):
        mine = sorted((r.id, r.row_number) for r in found if r.connection == connection)
        assert [n for _, n in mine] == list(range(2, 102))


def test_a_plain_sheet_of_six_columns(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("Database,Schema,Tables,Columns,Datatype,IsPII\nd,s,t,a,INT,Yes\nd,s,t,b,INT,No\nd,s,t,c,INT,No\n")
    found = read_inventory(spark, str(path), "csv", connection="CRM")
    assert [(r.column_name, r.row_number) for r in found.orderBy("row_number").collect()] == [("a", 2), ("b", 3), ("c", 4)]


def test_a_position_that_is_no_number(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Database,Schema,Tables,Columns,Datatype,IsPII,row_number\nd,s,t,a,INT,Yes,2\nd,s,t,b,INT,No,two\n")
    found = read_inventory(spark, str(path), "csv", connection="CRM")
    assert {r.column_name: r.row_number for r in found.collect()} == {"a": 2, "b": None}


def test_missing_and_same_and_unknown_input(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_inventory(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="same"):
        compare_locations(spark, f"{tmp_path}/a", f"{tmp_path}/b/../a")
    with pytest.raises(ValueError, match="xlsx"):
        read_inventory(spark, "x.xlsx", "xlsx")


def test_connections_in_common(spark):
    prev, curr = golden_pair(spark)
    with pytest.raises(ValueError, match="in common"):
        compare(prev.filter("connection = 'OLD'"), curr)
    padded = curr.withColumn("connection", F.concat(F.lit(" "), "connection"))
    assert compare(prev, padded).drift.count() == 17
    found = {(r.connection, r.side) for r in unmatched_connections(prev, padded).collect()}
    assert found == {("OLD", "prev"), ("NEW", "curr")}


def header_frame(spark, by_connection):
    data = [(c, i, h) for c, found in by_connection.items() for i, h in enumerate(found)]
    return spark.createDataFrame(data, "connection STRING, pos INT, header STRING")


def test_database_header(spark):
    prev, curr = golden_pair(spark)
    checks.check_headers(prev, curr, header_frame(spark, {"CRM": ["x", " DB "], "OLD": ["y"]}))
    with pytest.raises(ValueError, match="database header"):
        # Only connections on both sides count.
        checks.check_headers(prev, curr, header_frame(spark, {"CRM": ["x"], "OLD": ["Database"]}))


def write_sheets(path, by_connection):
    for connection, (header, body) in by_connection.items():
        folder = path / f"connection={connection}"
        folder.mkdir(parents=True)
        lines = [",".join(header)] + [
            ",".join([str(r[-1]), *('"' + (c or "") + '"' for c in r[1:-1])]) for r in body
        ]
        (folder / "part-0.csv").write_text("\n".join(lines) + "\n")
    return str(path)


def sheet_rows(spark, path):
    found = sheets.sheet_inventory(sheets.csv_sheets(spark, str(path)), sheets.csv_sheet_headers(spark, str(path)))
    return sorted(map(tuple, found.select("connection", "column_name", "datatype", "row_number").collect()))


def test_sheets_of_any_width_and_with_line_breaks(spark, tmp_path):
    folder = tmp_path / "connection=C"
    folder.mkdir()
    wide = [f"x{i}" for i in range(70)]
    header = ",".join([*wide, "Database,Schema,Tables,Columns,Datatype,IsPII"])
    body = [",".join([*["v"] * 70, f'd,s,t,"c\n{i}",INT,No']) for i in range(3)]
    (folder / "a.csv").write_text("\n".join([header, *body]) + "\n")
    assert sheet_rows(spark, tmp_path) == [("C", f"c\n{i}", "INT", i + 2) for i in range(3)]


def test_two_layouts_in_one_connection(spark, tmp_path):
    for name in ("007", "7"):
        folder = tmp_path / f"connection={name}"
        folder.mkdir()
        (folder / "a.csv").write_text("Database,Schema,Tables,Columns,Datatype,IsPII\nd,s,t,a,INT,No\nd,s,t,b,INT,No\n")
        (folder / "b.csv").write_text("IsPII,Datatype,Columns,Tables,Schema,Database,Owner\nNo,DATE,c,t,s,d,me\n")
    one = [("a", "INT", 2), ("b", "INT", 3), ("c", "DATE", 4)]
    assert sheet_rows(spark, tmp_path) == sorted((name, *r) for name in ("007", "7") for r in one)


def test_further_columns_are_kept_in_the_annotated_copy(spark, tmp_path):
    for side, owner in (("prev", "x"), ("curr", "y")):
        folder = tmp_path / side / "connection=C"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text(f"Database,Schema,Tables,Columns,Datatype,IsPII,Owner\nd,s,t,a,INT,No,{owner}\n")
    result = compare_sheets(spark, str(tmp_path / "prev"), str(tmp_path / "curr"))
    assert [[tuple(f) for f in r.further] for r in result.annotated_inventory.collect()] == [[("Owner", "y")]]


def test_columns_without_a_header_are_kept(spark, tmp_path):
    for side in ("prev", "curr"):
        folder = tmp_path / side / "connection=C"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("Database,,Schema,Tables,Columns,Datatype,IsPII,Owner,\nd,note,s,t,a,INT,No,me,,more\nd,,s,t,b\n")
    result = compare_sheets(spark, str(tmp_path / "prev"), str(tmp_path / "curr"))
    found = {r.column_name: [tuple(f) for f in r.further] for r in result.annotated_inventory.collect()}
    assert found == {
        "a": [("Unnamed: 1", "note"), ("Owner", "me"), ("Unnamed: 8", None), ("Unnamed: 9", "more")],
        "b": [("Unnamed: 1", None), ("Owner", None), ("Unnamed: 8", None)],
    }


@pytest.fixture
def sheet_folders(tmp_path):
    bad = ["row", "DB", "Schema", "Tables", "Columns", "Datatype", "IsPII"]
    prev = write_sheets(
        tmp_path / "prev",
        {"CRM": (HEADER, rows(PREVIOUS)), "BAD": (bad, rows(PREVIOUS, "BAD")), "OLD": (HEADER, rows(PREVIOUS))},
    )
    other = ["row", "dbname", "db_schema", "Table", "Col", "dtype", "is_pii"]
    curr = write_sheets(
        tmp_path / "curr",
        {"CRM": (other, rows(CURRENT)), "BAD": (other, rows(CURRENT, "BAD"))},
    )
    return prev, curr


def test_csv_sheets_with_headers_of_their_own(spark, sheet_folders):
    prev, curr = sheet_folders
    found = sheets.csv_sheet_headers(spark, prev)
    assert {(r.connection, r.pos): r.header for r in found.collect()}["CRM", 5] == "DATA_TYPE"
    result = compare_sheets(spark, prev, curr)
    assert {r.connection for r in result.drift.collect()} == {"CRM"}
    assert result.drift.count() == 17
    assert tuple(result.run_status.first()) == (17, 1, 3)
    status = headers.connection_status(found, sheets.csv_sheet_headers(spark, curr))
    assert {r.connection: r.reason for r in status.collect()} == {"CRM": "", "BAD": "prev lacks Database"}


def test_written_results(spark, tmp_path):
    prev, curr = write_golden(spark, tmp_path)
    out = str(tmp_path / "out")
    assert run([prev, curr, out], spark) == 1
    drift = spark.read.parquet(f"{out}/drift")
    assert drift.count() == 17 and "comparison_ts" in drift.columns
    assert spark.read.parquet(f"{out}/critical_changes").count() == 10
    assert spark.read.parquet(f"{out}/drift_summary").count() == 14
    annotated = spark.read.parquet(f"{out}/annotated_inventory")
    kinds = {r.row_kind: r["count"] for r in annotated.groupBy("row_kind").count().collect()}
    assert kinds == {"inventory": 13, "dropped": 7}
    assert spark.read.parquet(f"{out}/rejected_rows").isEmpty()


def test_every_data_set_is_written_anew(spark, tmp_path):
    """A run with drift, then one without to the same path: nothing stale, and empty data sets have their schema."""
    prev, curr = write_golden(spark, tmp_path)
    other, out = str(tmp_path / "copy"), str(tmp_path / "out")
    spark.read.parquet(prev).write.parquet(other)
    assert run([prev, curr, out], spark) == 1
    names = {p.name for p in (tmp_path / "out").iterdir()}
    columns = {name: set(spark.read.parquet(f"{out}/{name}").columns) for name in names}
    assert len(names) == 12
    assert run([prev, other, out], spark) == 0
    assert {name: set(spark.read.parquet(f"{out}/{name}").columns) for name in names} == columns
    for name in ("drift", "critical_changes", "critical_table", "rejected_rows", "drift_by_connection"):
        assert spark.read.parquet(f"{out}/{name}").isEmpty()
    assert spark.read.parquet(f"{out}/run_status").first().status == 0


def test_command_line_errors_and_partial_runs(spark, tmp_path, sheet_folders):
    prev, curr = sheet_folders
    out = str(tmp_path / "out")
    assert run([prev, prev, out], spark) == 2
    assert run([prev, str(tmp_path / "none"), out], spark) == 2
    assert run([prev, curr, out, "--format", "sheets"], spark) == 3
    status = spark.read.parquet(f"{out}/connection_status").collect()
    assert {r.connection: r.status for r in status} == {"CRM": "ok", "BAD": "failed"}


def test_a_large_connection_is_written_by_several_tasks(spark, tmp_path):
    path = tmp_path / "x"
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(0, 200_000, 1, 8).selectExpr(
            "IF(id % 100 = 0, 'small', 'large') AS connection", "uuid() AS value"
        )
        sinks.write_by_connection(df, str(path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((path / "connection=large").glob("*.parquet"))) > 2
    assert spark.read.parquet(str(path)).count() == 200_000


def test_the_same_result_from_stored_snapshots(spark, tmp_path):
    found = registry.comparison(spark, "/root/testdata/sf0.001", messy=True)
    found.prev.write.parquet(str(tmp_path / "p"))
    found.curr.write.parquet(str(tmp_path / "c"))
    stored = compare_locations(spark, str(tmp_path / "p"), str(tmp_path / "c")).drift
    assert sorted(map(str, stored.collect())) == sorted(
        map(str, Comparison(found.prev, found.curr).drift.collect())
    )


def test_large_csv_sheets_are_read_in_blocks(spark, tmp_path):
    """Any place of a block's end gives the same records, also inside quotes, beside odd line breaks and bad bytes."""
    contents = {
        "connection=a b/1.csv": "﻿Database,Schema,Tables\n" + "".join(f'd,"s,{i}",t\r\n' for i in range(60)),
        "connection=a b/2+ü.csv": 'Database,"Sche\nma"\n\n' + 'd,"x\n\ny"\nd,a"b\r' * 9 + 'd,"open\n',
        "connection=a b/3.csv": 'Database,Schema\nd,"open',
        "connection=c/1.csv": "\n\nDatabase\n",
        "connection=c/2.csv": "Database,Schema\n" + "dé,\n" * 20,
    }
    expected, headers, last = [], [], {}
    for name, text in contents.items():
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(text.encode() + (b"\xff\xc3\nq" if name.endswith("c/2.csv") else b""))
        connection = file.parent.name.partition("=")[2]
        text = file.read_bytes().decode("utf-8-sig", "replace")
        first, *rows = [[c or None for c in r] for r in csv.reader(io.StringIO(text, newline="")) if r]
        headers += [(connection, pos, x) for pos, x in enumerate(first)]
        for row in rows:
            last[connection] = last.get(connection, 1) + 1
            expected.append((connection, last[connection], row))
    for size in ("23", "64", "300", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = sheets.csv_sheets(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
            names = sheets.csv_sheet_headers(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r.connection, r.row_number, r.cells) for r in found) == sorted(expected)
        assert sorted((r.connection, r.pos, r.header) for r in names) == sorted(headers)
        if size == "64":
            assert len({r.task for r in found if r.file.endswith("b/1.csv")}) > 5
