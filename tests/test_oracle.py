"""Every registered query next to its SQL, and the totals expected of the derived snapshots."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from catadrift.plans import oracle, registry

DATA = Path("/root/testdata")
SMALL = DATA / "sf0.001"
QUERIES, SQL = registry.queries(), oracle.oracle_sql()

# change type, flag: rows at sf0.001 and sf0.01.
TOTALS = {
    ("New Database Added", "Unknown"): (5, 5),
    ("Database Dropped", "Yes"): (4, 4),
    ("Database Dropped", "No"): (1, 1),
    ("New Schema Added", "Yes"): (44, 428),
    ("New Schema Added", "No"): (82, 683),
    ("New Schema Added", "Unknown"): (17, 175),
    ("Schema Dropped", "Yes"): (1, 1),
    ("Schema Dropped", "No"): (1, 1),
    ("New Table Added", "Yes"): (108, 773),
    ("New Table Added", "No"): (133, 707),
    ("New Table Added", "Unknown"): (39, 244),
    ("Table Dropped", "Yes"): (4, 26),
    ("Table Dropped", "No"): (54, 627),
    ("New Column Added", "Yes"): (64, 761),
    ("New Column Added", "No"): (117, 1244),
    ("New Column Added", "Unknown"): (35, 303),
    ("Column Dropped", "Yes"): (77, 766),
    ("Column Dropped", "No"): (118, 1229),
    ("Column Dropped", "Unknown"): (27, 291),
    ("Datatype Changed", "Yes"): (53, 504),
    ("Datatype Changed", "No"): (83, 838),
    ("Datatype Changed", "Unknown"): (12, 194),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SMALL))
    columns = sorted(df.columns)
    mine = Counter(tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({SQL[name]})")
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert mine == Counter(expected.fetchall())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_totals(spark, scale):
    place = 0 if scale == "sf0.001" else 1
    drift = registry.comparison(spark, str(DATA / scale)).drift
    found = {(r.change_type, r.is_pii): r["count"] for r in drift.groupBy("change_type", "is_pii").count().collect()}
    assert found == {pair: counts[place] for pair, counts in TOTALS.items()}
