"""What must hold for any pair of snapshots."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catadrift import Comparison
from catadrift.config import KEY, NEW_DATABASE
from tests.snapshots import SCHEMA

N_CONNECTIONS = 30


def random_side(seed):
    """Small snapshots, one per connection, out of few names so that sides overlap."""
    rng = random.Random(seed)
    rows = []
    for connection in range(N_CONNECTIONS):
        names = [rng.choice(["a", "b"]) for _ in range(2)]
        for position in range(rng.randint(1, 14)):
            pad = rng.choice(["", "", "", " ", "\t", "\u3000"])
            rows.append((
                f"c{connection}",
                pad + rng.choice(names),
                rng.choice("st") + pad,
                rng.choice("tuv"),
                rng.choice("xyz"),
                rng.choice(["INT", "INT ", "CHAR", None]),
                rng.choice(["Yes", "no", " 1", "?", None]),
                position + 2,
            ))
    return rows


def collect(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module", params=[1, 2])
def pair(spark, request):
    return random_side(request.param), random_side(request.param + 100)


def drift(spark, prev, curr):
    return Comparison(spark.createDataFrame(prev, SCHEMA), spark.createDataFrame(curr, SCHEMA)).drift


def strip_rows(rows):
    """Cleaned and deduplicated rows by connection and key, by plain Python."""
    found = {}
    flags = {"yes": "Yes", "1": "Yes", "no": "No"}
    for connection, *names, kind, flag, position in sorted(rows, key=lambda r: r[-1]):
        key = (connection, *(n.strip() for n in names))
        kind = kind.strip() if kind is not None else None
        value = flags.get((flag or "").strip().lower(), "Unknown")
        found.setdefault(key, (kind, value, position))
    return found


def brute_force(prev, curr):
    """Drift by comparing every key with the sets of names of the other side."""
    p, c = strip_rows(prev), strip_rows(curr)
    prefixes = {side: {k[:n] for k in rows for n in range(1, 6)} for side, rows in (("p", p), ("c", c))}

    def level(key, other):
        return next(n for n in range(1, 6) if key[:n] not in prefixes[other])

    out, groups = [], {}
    for key in p.keys() | c.keys():
        if key in p and key in c:
            if p[key][0] != c[key][0]:
                text = f"{p[key][0] or 'nan'} → {c[key][0] or 'nan'}"
                out.append((*key, text, "Datatype Changed", c[key][1], c[key][2]))
            continue
        side, rows, other = ("New", c, "p") if key in c else ("Dropped", p, "c")
        found = level(key, other)
        if found == 1:
            continue
        kind, flag, position = rows[key]
        name = {2: "Database", 3: "Schema", 4: "Table", 5: "Column"}[found]
        change = f"New {name} Added" if side == "New" else f"{name} Dropped"
        if change in ("New Database Added", "Database Dropped", "Schema Dropped"):
            groups.setdefault((*key[:3], "N/A", "N/A", "N/A", change), []).append((flag, position))
        elif change == "Table Dropped":
            groups.setdefault((*key[:4], change), []).append((flag, key[4], kind))
        else:
            out.append((*key, kind, change, flag, position if side == "New" else None))
    for group, members in groups.items():
        yes = [m for m in members if m[0] == "Yes"]
        if group[-1] == "Table Dropped":
            if yes:
                out += [(*group[:4], name, kind, group[-1], "Yes", None) for _, name, kind in yes]
            else:
                out.append((*group[:4], "N/A", "N/A", group[-1], "No", None))
        elif group[-1] == NEW_DATABASE:
            out.append((*group, "Unknown", min(position for _, position in members)))
        else:
            out.append((*group, "Yes" if yes else "No", None))
    return Counter(out)


def test_equals_brute_force(spark, pair):
    found = drift(spark, *pair).select(*KEY, "datatype", "change_type", "is_pii", "row_number")
    assert collect(found) == brute_force(*pair)


def test_identical_snapshots_do_not_drift(spark, pair):
    assert drift(spark, pair[0], pair[0]).isEmpty()


def test_order_and_partitions_do_not_matter(spark, pair):
    expected = collect(drift(spark, *pair))
    shuffled = [random.Random(5).sample(side, len(side)) for side in pair]
    assert collect(drift(spark, *shuffled)) == expected


def test_repeated_rows_do_not_matter(spark, pair):
    again = [side + [(*row[:-1], row[-1] + 1000) for row in side] for side in pair]
    assert collect(drift(spark, *again)) == collect(drift(spark, *pair))


def test_connections_are_independent(spark, pair):
    whole = drift(spark, *pair)
    half = [[r for r in side if int(r[0][1:]) % 2 == 0] for side in pair]
    expected = collect(whole.filter("CAST(substring(connection, 2) AS INT) % 2 = 0"))
    assert collect(drift(spark, *half)) == expected


def test_swapping_sides_swaps_new_and_dropped(spark, pair):
    def names(df, change, level):
        return collect(df.filter(F.col("change_type") == change).select(*KEY[:level]).distinct())

    forth, back = drift(spark, *pair), drift(spark, *pair[::-1])
    for name, level in (("Database", 2), ("Schema", 3), ("Table", 4), ("Column", 5)):
        assert names(forth, f"New {name} Added", level) == names(back, f"{name} Dropped", level)


def test_a_key_has_one_change(spark, pair):
    assert drift(spark, *pair).groupBy(*KEY).count().filter("count > 1").isEmpty()
