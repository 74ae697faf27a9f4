"""The hand-made pair, result by result."""

import pytest

from catadrift import Comparison, compare
from catadrift.config import ACTIONS
from catadrift.operators import metrics
from catadrift.plans import registry
from tests.snapshots import CURRENT, PREVIOUS, frame, golden_pair, rows

DRIFT = """
C_DB.x.N/A.N/A|N/A|New Database Added|Unknown|HIGH|12
C_DB.y.N/A.N/A|N/A|New Database Added|Unknown|HIGH|14
B_DB.s1.N/A.N/A|N/A|Database Dropped|Yes|HIGH|-
B_DB.s2.N/A.N/A|N/A|Database Dropped|No|MEDIUM|-
A_DB.mkt.Lead.Email|VARCHAR|New Schema Added|Yes|HIGH|10
A_DB.mkt.Click.Url|VARCHAR|New Schema Added|No|MEDIUM|11
A_DB.hr.N/A.N/A|N/A|Schema Dropped|Yes|HIGH|-
A_DB.tmp.N/A.N/A|N/A|Schema Dropped|No|MEDIUM|-
A_DB.dbo.Invoice.InvID|INT|New Table Added|No|MEDIUM|8
A_DB.dbo.Invoice.TaxID|VARCHAR|New Table Added|Yes|HIGH|9
A_DB.dbo.Cards.PAN|CHAR(16)|Table Dropped|Yes|HIGH|-
A_DB.dbo.Orders.N/A|N/A|Table Dropped|No|MEDIUM|-
A_DB.dbo.Customer.DOB|DATE|New Column Added|Yes|HIGH|6
A_DB.dbo.Customer.Tier|INT|New Column Added|Unknown|LOW|7
A_DB.dbo.Customer.Phone|CHAR(10)|Column Dropped|Yes|HIGH|-
A_DB.dbo.Customer.CustomerID|INT → BIGINT|Datatype Changed|No|MEDIUM|3
A_DB.dbo.Customer.Notes|TEXT → CLOB|Datatype Changed|Yes|HIGH|4
"""
METRICS = {
    "New Databases": 1, "Dropped Databases": 1, "New Schemas": 1, "Dropped Schemas": 2,
    "New Tables": 3, "Dropped Tables": 4, "New PII Columns": 3, "New Non PII Columns": 2,
    "Dropped PII Columns": 5, "Dropped Non PII Columns": 5, "Datatype Changes": 2,
    "HIGH Severity": 10, "MEDIUM Severity": 6, "LOW Severity": 1,
}


@pytest.fixture(scope="module")
def result(spark):
    return compare(*golden_pair(spark), comparison_ts="2026-03-17 08:30:00").materialise()


def test_drift_rows(result):
    found = sorted(
        "|".join([
            f"{r.db_name}.{r.schema_name}.{r.table_name}.{r.column_name}", r.datatype,
            r.change_type, r.is_pii, r.severity, "-" if r.row_number is None else str(r.row_number),
        ])
        for r in result.drift.collect()
    )
    assert found == sorted(DRIFT.strip().split("\n"))


def test_drift_rows_carry_connection_stamp_and_action(result):
    for row in result.drift.collect():
        assert row.connection == "CRM"
        assert row.comparison_ts == "2026-03-17 08:30:00"
        with_pii, without = ACTIONS[row.change_type]
        assert row.action == (with_pii if row.is_pii == "Yes" else without)


def test_side_counts(result):
    assert tuple(result.side_counts.first()) == (2, 2, 1, 2)


def test_summary(result):
    found = result.drift_summary.orderBy("ord").collect()
    assert {r.metric: r["count"] for r in found} == METRICS
    assert [r.metric for r in found] == list(METRICS)


def test_counts_from_drift_rows_are_the_same(result, spark):
    again = metrics.drift_counts(result.drift, result.side_counts)
    assert again.first().asDict() == result.metrics.first().asDict()
    large = registry.comparison(spark, "/root/testdata/sf0.001").materialise()
    again = metrics.drift_counts(large.drift, large.side_counts)
    assert again.first().asDict() == large.metrics.first().asDict()


def test_counts_of_no_drift(spark):
    prev, _ = golden_pair(spark)
    assert set(Comparison(prev, prev).metrics.first()) == {0}


def test_status(result):
    assert tuple(result.run_status.first()) == (17, 0, 1)


def test_annotation_marks_every_positioned_row_once(result):
    marked = {
        r.row_number: r.change_type
        for r in result.annotated_inventory.collect()
        if r.change_type is not None
    }
    assert marked == {
        r.row_number: r.change_type for r in result.drift.collect() if r.row_number is not None
    }


def test_annotation_keeps_all_connections_and_drops_duplicates(result):
    found = result.annotated_inventory.collect()
    assert {r.connection for r in found} == {"CRM", "NEW"}
    # The second CustomerID is a duplicate.
    assert sorted(r.row_number for r in found if r.connection == "CRM") == [
        2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14,
    ]
    unknown = next(r for r in found if r.column_name == "Tier")
    assert (unknown.severity, unknown.fill, unknown.is_pii_raw) == ("LOW", None, "unk")


def test_connections_are_ok_without_header_rows(result):
    assert [tuple(r) for r in result.connection_status.collect()] == [("CRM", "ok", "")]


def test_rejected_rows_are_listed_and_no_drift(spark):
    data = rows(CURRENT)
    broken = [
        ("CRM", None, "s", "t", "c", "INT", "Yes", 90),
        ("CRM", "A_DB", None, "t", None, "INT", "Yes", 91),
    ]
    prev = frame(spark, rows(PREVIOUS))
    plain = Comparison(prev, frame(spark, data))
    with_nulls = Comparison(prev, frame(spark, data + broken))
    assert with_nulls.drift.exceptAll(plain.drift).isEmpty()
    assert with_nulls.drift.count() == plain.drift.count()
    found = {r.row_number: (r.side, r.reason) for r in with_nulls.rejected_rows.collect()}
    assert found == {90: ("curr", "null db_name"), 91: ("curr", "null schema_name, column_name")}


def test_null_datatypes(spark):
    def side(*kinds):
        return frame(spark, [("C", "d", "s", "t", f"c{i}", k, "No", i) for i, k in enumerate(kinds, 2)])

    found = Comparison(side(None, None, "INT", "INT"), side(None, "INT", None, "INT")).drift
    assert sorted((r.column_name, r.datatype) for r in found.collect()) == [
        ("c3", "nan → INT"), ("c4", "INT → nan"),
    ]


def test_failed_connections_are_left_out_whole(spark):
    prev, curr = golden_pair(spark)
    status = spark.createDataFrame(
        [(" CRM", "failed", "curr lacks Schema"), ("B", "ok", "")],
        "connection STRING, status STRING, reason STRING",
    )
    result = Comparison(prev, curr, status)
    assert result.drift.isEmpty()
    assert tuple(result.run_status.first()) == (0, 1, 3)
