"""What the plans look like: shared scans, pruned columns, no Python, no cartesian product, split hot groups."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from catadrift import Comparison
from catadrift.operators import quality
from catadrift.plans import registry
from catadrift.plans import session
from catadrift.plans.session import cut, join_facts, join_salted, salts, tuning
from tests.snapshots import frame

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


# A record of a sheet may have any width and quoted line breaks, which only a parser in Python tells.
READERS = {"sheet_reader", "sheet_reader_positions", "workbook_reader", "report_workbook"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - READERS))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(registry.queries()[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "ArrowEval"):
        assert node not in text


def test_each_side_is_scanned_once_per_grouping(spark):
    """Twice for the keys and twice for the tables, however many branches use them."""
    text = final_plan(registry.comparison(spark, SMALL).drift)
    assert text.count("FileScan parquet") == 4
    assert "ReusedExchange" in text
    for columns in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert set(re.findall(r"(\w+):", columns)) <= {
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        }


def test_table_scan_reads_names_only(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    registry.comparison(spark, SMALL).prev.write.parquet(path)
    df = spark.read.parquet(path)
    text = final_plan(Comparison(df, df).names["table"])
    for columns in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert not {"datatype", "is_pii_raw", "row_number"} & set(re.findall(r"(\w+):", columns))


def partitioned(spark, tmp_path):
    """Both derived snapshots, written in a folder per connection."""
    found = registry.comparison(spark, SMALL)
    for name in ("prev", "curr"):
        getattr(found, name).write.partitionBy("connection").parquet(str(tmp_path / name))
    return tuple(spark.read.parquet(str(tmp_path / name)) for name in ("prev", "curr"))


def test_partitioned_snapshots_share_their_scans_too(spark, tmp_path):
    prev, curr = partitioned(spark, tmp_path)
    drift = Comparison(prev, curr).drift
    text = final_plan(drift)
    assert text.count("FileScan parquet") == 4
    assert "dynamicpruning" not in text
    assert drift.count() == 1079


def test_filter_on_connection_reaches_the_scan(spark, tmp_path):
    sides = [df.filter("connection = 'conn_1'") for df in partitioned(spark, tmp_path)]
    text = final_plan(Comparison(*sides).drift)
    filters = re.findall(r"PartitionFilters: \[([^]]*)\]", text)
    assert len(filters) == 4 and all("= conn_1" in f for f in filters)


def test_hot_group_is_spread(spark):
    rows = spark.range(40_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('t', id)) AS t", "concat('c', id) AS c"
    )
    groups = rows.select("t").distinct().withColumn("fact", F.length("t"))
    with settings(spark, spark__sql__adaptive__enabled="false", **NO_BROADCAST):
        joined = join_salted(rows, groups, ["t"], "c")
        tasks = joined.filter("t = 'hot'").groupBy(F.spark_partition_id().alias("task")).count()
        found = [r["count"] for r in tasks.collect()]
    assert sum(found) == 13_334
    assert len(found) >= salts(spark) // 2 and max(found) < 13_334 / 2
    assert joined.count() == 40_000 and joined.filter("fact IS NULL").isEmpty()


def test_salts_follow_the_partitions(spark):
    with settings(spark, spark__sql__shuffle__partitions="40000"):
        assert salts(spark) == 200
    assert salts(spark) == 8


def test_results_do_not_depend_on_broadcasts(spark):
    expected = registry.comparison(spark, SMALL).drift.collect()
    with settings(spark, **NO_BROADCAST):
        df = registry.comparison(spark, SMALL).drift
        assert sorted(map(str, df.collect())) == sorted(map(str, expected))
        assert "Broadcast" not in plan(df)


def test_adaptive_execution_splits_copies_of_a_hot_key(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    spark.range(0, 60_000, 1, 12).selectExpr(
        "'C' AS connection", "'d' AS db_name", "'s' AS schema_name", "'t' AS table_name",
        "IF(id % 3 = 0, 'hot', concat('c', id)) AS column_name", "'INT' AS datatype",
        "'no' AS is_pii_raw", "id AS row_number",
    ).write.parquet(path)
    with settings(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        **NO_BROADCAST,
    ):
        removed = quality.duplicates(spark.read.parquet(path))
        assert "skew=true" in final_plan(removed)
        assert removed.count() == 19_999


def test_hot_dropped_table_and_duplicated_key(spark):
    """A third of the rows in one dropped table, a third copies of one key."""
    base = spark.range(30_000).selectExpr(
        "'C' AS connection", "'d' AS db_name", "'s' AS schema_name",
        "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'keep' ELSE concat('t', id % 50) END AS table_name",
        "IF(id % 3 = 1, 'copy', concat('c', id)) AS column_name", "'INT' AS datatype",
        "IF(id % 30 = 0, 'yes', 'no') AS is_pii_raw", "id + 2 AS row_number",
    )
    result = Comparison(base, base.filter("table_name != 'hot'"))
    found = {(r.change_type, r.is_pii): r["count"] for r in result.drift.groupBy("change_type", "is_pii").count().collect()}
    assert found == {("Table Dropped", "Yes"): 1000}


def test_tuning_keeps_the_size_of_partitions(spark):
    small, medium, large = tuning(1 << 20), tuning(1 << 40), tuning(100 << 40)
    partitions = [int(t["spark.sql.shuffle.partitions"]) for t in (small, medium, large)]
    assert partitions == [8, 2048, 204_800]
    assert {t["spark.sql.files.maxPartitionBytes"] for t in (small, medium, large)} == {str(512 << 20)}
    assert large["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_salted_join_sorts_by_a_hash(spark):
    rows = spark.range(100).selectExpr("concat('t', id % 7) AS t", "concat('c', id) AS c")
    groups = rows.select("t").distinct().withColumn("fact", F.length("t"))
    with settings(spark, spark__sql__adaptive__enabled="false", **NO_BROADCAST):
        joined = join_salted(rows, groups, ["t"], "c")
        sorts = re.findall(r"Sort \[(\w+)#", plan(joined))
    assert sorts and set(sorts) == {"join_hash"}
    assert joined.columns == ["t", "c", "fact"] and joined.filter("fact = 2").count() == 100


def test_missing_levels_are_found_without_sorting_tables(spark):
    """The keys alone are sorted; an aggregate over text would sort tables too."""
    with settings(spark, spark__sql__adaptive__enabled="false", **NO_BROADCAST):
        keys = re.findall(r"SortAggregate\(key=\[(\w+)#", plan(registry.comparison(spark, SMALL).drift))
    assert keys and set(keys) == {"key_hash"}


def test_marks_join_the_snapshot_as_its_aggregate_left_it(spark):
    """No shuffle and no sort between removing duplicates and joining the marks."""
    with settings(spark, spark__sql__adaptive__enabled="false", **NO_BROADCAST):
        text = plan(registry.comparison(spark, SMALL, messy=True).annotated_inventory)
    join = text.split("SortMergeJoin [key_hash")[1].splitlines()[1:]
    left = next(line for line in join if re.search(r"SortAggregate|Exchange|Sort ", line))
    assert "SortAggregate(key=[key_hash" in left
    assert "Exchange hashpartitioning(key#" not in text


def test_derived_rows_are_filtered_before_their_names_are_made(spark):
    """Nor does the stage that makes them outgrow what the JVM compiles (8000 bytes a method)."""
    with settings(spark, spark__sql__adaptive__enabled="false", **NO_BROADCAST):
        df = registry.comparison(spark, SMALL, messy=True).drift
        filters = [line for line in plan(df).splitlines() if "Filter" in line and "l_suppkey" in line]
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(
            df._jdf.queryExecution().executedPlan()
        )
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert filters and not any("concat" in line for line in filters)
    assert sizes and max(sizes) <= 8000


def test_frames_have_the_inventory_schema(spark):
    assert frame(spark, []).columns == registry.comparison(spark, SMALL).prev.columns


def test_cut_leaves_columns_and_no_shuffle_files(spark):
    rows = spark.range(200_000).selectExpr("concat('a name of some length ', id div 10) AS t", "id")
    groups = rows.groupBy("t").agg(F.max("id").alias("id"))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = str(manager.getAllBlocks()).count("shuffle_")
    found = cut(groups)
    assert str(manager.getAllBlocks()).count("shuffle_") <= before
    assert found.schema == groups.schema and found.count() == 20_000
    files = spark.read.format("binaryFile").load(found.inputFiles()).select("length")
    assert files.agg(F.sum("length")).first()[0] < 20_000 * 20
    assert spark.conf.get(session.FREE_SHUFFLES, None) in (None, "false")


def test_joining_small_facts_leaves_the_rows_where_they_are(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5)], "t string, n int")
    facts = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "none")], "t string, fact string")
    expected = {"inner": ["x", "x", "y", "none"], "left": ["x", "x", "y", "none", None]}
    for how, found in expected.items():
        with settings(spark, **NO_BROADCAST):
            joined = join_facts(rows, facts, ["t"], "n", how)
            assert [r.fact for r in joined.orderBy("n").collect()] == found and joined.columns == ["t", "n", "fact"]
            assert "Exchange hashpartitioning" not in plan(joined)
            with monkeypatch.context() as m:
                m.setattr(session, "SMALL_FACTS", 0)
                salted = join_facts(rows, facts, ["t"], "n", how)
            assert [r.fact for r in salted.orderBy("n").collect()] == found
            assert "Exchange hashpartitioning" in plan(salted)


def test_report_starts_from_the_changes(spark):
    """The shuffles of the comparison are gone when the snapshot is shuffled, which alone is read again."""
    text = plan(registry.queries()["annotated_report"](spark, SMALL))
    assert text.count("lineitem.parquet") == 1
