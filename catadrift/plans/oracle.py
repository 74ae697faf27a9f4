"""The registered queries in plain SQL, for checking them on another engine.

The SQL is worked out apart from the Spark code: names are compared by anti and semi joins
level by level, duplicates found by window, whitespace removed by regular expression.
"""

from __future__ import annotations

from catadrift.config import (
    ACTIONS,
    CHANGE_BARS,
    HEADER_PATTERNS,
    HIGHLIGHTS,
    METRICS,
    NO_VALUES,
    SECTIONS,
    SEVERITY_BARS,
    TINTS,
    YES_VALUES,
)
from catadrift.operators import pages
from catadrift.plans.derived import AFTER, BEFORE, DATATYPES, FLAGS, POSITION_STEP, SPELLINGS

KEY = "connection, db_name, schema_name, table_name, column_name"
ALL = f"{KEY}, datatype, is_pii_raw, row_number"


def _text(value: str | None) -> str:
    if value is None:
        return "NULL"
    parts = "".join(c if c.isprintable() and (c == " " or not c.isspace()) else "\0%d\0" % ord(c) for c in value)
    pieces = [
        f"chr({p})" if i % 2 else "'" + p.replace("'", "''") + "'"
        for i, p in enumerate(parts.split("\0"))
    ]
    return " || ".join(p for p in pieces if p != "''") or "''"


def _list(values: tuple) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _strip(column: str) -> str:
    edge = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"
    return f"regexp_replace({column}, '^{edge}|{edge}$', '', 'g')"


def _flag(column: str) -> str:
    flag = f"lower({_strip(f'coalesce({column}, {chr(39) * 2})')})"
    return (
        f"CASE WHEN {flag} IN {YES_VALUES} THEN 'Yes' WHEN {flag} IN {NO_VALUES} THEN 'No' "
        "ELSE 'Unknown' END"
    )


def _inventory(side: str, messy: bool) -> str:
    if side == "prev":
        left_out = "k % 12 = 11 OR k % 60 IN (4, 17) OR t % 20 = 3 OR c % 13 = 0 OR k % 97 = 1"
        kind, null_type = "p % 5", "p % 9 = 4 OR p % 13 = 6"
    else:
        left_out = "k % 12 = 10 OR k % 60 IN (5, 18) OR t % 20 = 5 OR c % 13 = 1 OR k % 97 = 0"
        kind, null_type = "(p % 5 + CASE WHEN c % 17 = 2 THEN 1 ELSE 0 END) % 5", "p % 9 = 4 OR p % 11 = 5"
    plain = f"""
        SELECT *,
            CASE WHEN k % 97 = 0 THEN 'conn_prev_only' WHEN k % 97 = 1 THEN 'conn_curr_only'
                 ELSE 'conn_' || (k % 4) END AS connection,
            'db_' || (k % 12) AS db_name, 'sch_' || (k % 60) AS schema_name,
            'tbl_' || k AS table_name, 'col_' || ln AS column_name,
            {_list(DATATYPES)}[({kind}) + 1] AS datatype,
            CASE WHEN t % 4 = 1 OR k % 60 IN (18, 22) THEN 'no'
                 ELSE {_list(FLAGS)}[p % 12 + 1] END AS is_pii_raw,
            p * {POSITION_STEP} + s % {POSITION_STEP} AS row_number,
            {_list(BEFORE)}[s % 5 + 1] AS pre, {_list(AFTER)}[s % 4 + 1] AS post
        FROM (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s,
                     l_orderkey // 60 AS t, l_orderkey + l_linenumber AS c FROM lineitem)
        WHERE NOT ({left_out})"""
    if not messy:
        return f"SELECT {ALL} FROM ({plain})"
    return f"""
        SELECT CASE WHEN s % 59 = 11 THEN NULL WHEN s % 7 = 2 THEN ' ' || connection
                    ELSE connection END AS connection,
            CASE WHEN s % 41 <> 3 THEN pre || db_name || post END AS db_name,
            CASE WHEN s % 43 <> 5 THEN schema_name || pre END AS schema_name,
            CASE WHEN s % 47 <> 7 THEN post || table_name END AS table_name,
            CASE WHEN s % 53 <> 9 THEN column_name END AS column_name,
            CASE WHEN NOT ({null_type}) THEN datatype || pre END AS datatype,
            is_pii_raw, row_number
        FROM ({plain})"""


def _sides(messy: bool) -> str:
    """Both snapshots raw, stripped (_s), and deduplicated with complete keys (_d)."""
    parts = []
    for side in ("prev", "curr"):
        stripped = ", ".join(
            f"{_strip(c)} AS {c}" for c in (KEY + ", datatype, is_pii_raw").split(", ")
        )
        parts.append(f"""
        {side}_raw AS ({_inventory(side, messy)}),
        {side}_s AS (SELECT {stripped}, row_number, {_flag('is_pii_raw')} AS is_pii FROM {side}_raw),
        {side}_d AS (
            SELECT * FROM {side}_s
            WHERE connection IS NOT NULL AND db_name IS NOT NULL AND schema_name IS NOT NULL
              AND table_name IS NOT NULL AND column_name IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY row_number) = 1)""")
    return ",".join(parts)


DB = "connection, db_name"
SCHEMA = f"{DB}, schema_name"
TABLE = f"{SCHEMA}, table_name"


def _levels() -> str:
    """Rows of either side by the highest level at which they are missing on the other."""
    parts = []
    for side, other in (("prev", "curr"), ("curr", "prev")):
        x, o = side[0], f"{other}_d"
        parts.append(f"""
        {x}_all AS (SELECT * FROM {side}_d SEMI JOIN {o} USING (connection)),
        {x}_db AS (SELECT * FROM {x}_all ANTI JOIN {o} USING ({DB})),
        {x}_in_db AS (SELECT * FROM {x}_all SEMI JOIN {o} USING ({DB})),
        {x}_schema AS (SELECT * FROM {x}_in_db ANTI JOIN {o} USING ({SCHEMA})),
        {x}_in_schema AS (SELECT * FROM {x}_in_db SEMI JOIN {o} USING ({SCHEMA})),
        {x}_table AS (SELECT * FROM {x}_in_schema ANTI JOIN {o} USING ({TABLE})),
        {x}_in_table AS (SELECT * FROM {x}_in_schema SEMI JOIN {o} USING ({TABLE})),
        {x}_column AS (SELECT * FROM {x}_in_table ANTI JOIN {o} USING ({KEY}))""")
    parts.append(f"""
        both_sides AS (
            SELECT {KEY}, p.datatype AS prev_type, c.datatype AS curr_type,
                   c.is_pii, c.row_number
            FROM prev_d p JOIN curr_d c USING ({KEY}))""")
    return ",".join(parts)


def _drift() -> str:
    """CTE ``drift``, each change type on its own, and ``side`` with the side counts."""

    def action(change: str) -> str:
        yes, other = map(_text, ACTIONS[change])
        return f"WHEN change_type = '{change}' THEN CASE WHEN is_pii = 'Yes' THEN {yes} ELSE {other} END"

    any_yes = "CASE WHEN bool_or(is_pii = 'Yes') THEN 'Yes' ELSE 'No' END"
    na = "'N/A', 'N/A', 'N/A'"
    own = f"{KEY}, datatype"
    return f"""
        p_table_pii AS (SELECT DISTINCT {TABLE} FROM p_table WHERE is_pii = 'Yes'),
        found({KEY}, datatype, change_type, is_pii, row_number) AS (
            SELECT {SCHEMA}, {na}, 'New Database Added', 'Unknown', min(row_number)
            FROM c_db GROUP BY {SCHEMA}
            UNION ALL
            SELECT {SCHEMA}, {na}, 'Database Dropped', {any_yes}, NULL FROM p_db GROUP BY {SCHEMA}
            UNION ALL
            SELECT {own}, 'New Schema Added', is_pii, row_number FROM c_schema
            UNION ALL
            SELECT {SCHEMA}, {na}, 'Schema Dropped', {any_yes}, NULL FROM p_schema GROUP BY {SCHEMA}
            UNION ALL
            SELECT {own}, 'New Table Added', is_pii, row_number FROM c_table
            UNION ALL
            SELECT {own}, 'Table Dropped', is_pii, NULL FROM p_table WHERE is_pii = 'Yes'
            UNION ALL
            SELECT DISTINCT {TABLE}, 'N/A', 'N/A', 'Table Dropped', 'No', NULL::BIGINT
            FROM p_table ANTI JOIN p_table_pii USING ({TABLE})
            UNION ALL
            SELECT {own}, 'New Column Added', is_pii, row_number FROM c_column
            UNION ALL
            SELECT {own}, 'Column Dropped', is_pii, NULL FROM p_column
            UNION ALL
            SELECT {KEY}, coalesce(prev_type, 'nan') || ' → ' || coalesce(curr_type, 'nan'),
                   'Datatype Changed', is_pii, row_number
            FROM both_sides WHERE prev_type IS DISTINCT FROM curr_type),
        drift AS (
            SELECT *,
                CASE WHEN is_pii = 'Yes' THEN 'HIGH'
                     WHEN change_type = 'New Database Added' THEN 'HIGH'
                     WHEN change_type IN ('New Column Added', 'Column Dropped') THEN 'LOW'
                     ELSE 'MEDIUM' END AS severity,
                CASE {' '.join(map(action, ACTIONS))} END AS action
            FROM found),
        side AS (
            SELECT (SELECT count(DISTINCT ({TABLE})) FROM c_schema) AS tables_under_new_schema,
                (SELECT count(DISTINCT ({TABLE})) FROM p_schema) AS tables_under_dropped_schema,
                (SELECT count(*) FROM p_schema WHERE is_pii = 'Yes') AS pii_under_dropped_schema,
                (SELECT count(*) FROM p_schema WHERE is_pii = 'No') AS non_pii_under_dropped_schema)"""


def _metrics() -> str:
    """CTE ``metrics``: one row, a column for each metric."""
    new = "change_type IN ('New Column Added', 'New Table Added', 'New Schema Added', 'New Database Added')"
    dropped = "change_type LIKE '%Dropped'"

    def distinct(what: str, change: str) -> str:
        return f"count(DISTINCT ({what})) FILTER (WHERE change_type = '{change}')"

    def rows(condition: str) -> str:
        return f"count(*) FILTER (WHERE {condition})"

    def side(name: str) -> str:
        return f" + (SELECT {name} FROM side)"

    values = {
        "New Databases": distinct(DB, "New Database Added"),
        "Dropped Databases": distinct(DB, "Database Dropped"),
        "New Schemas": distinct(SCHEMA, "New Schema Added"),
        "Dropped Schemas": distinct(SCHEMA, "Schema Dropped"),
        "New Tables": distinct(TABLE, "New Table Added") + side("tables_under_new_schema"),
        "Dropped Tables": distinct(TABLE, "Table Dropped") + side("tables_under_dropped_schema"),
        "New PII Columns": rows(f"{new} AND is_pii = 'Yes'"),
        "New Non PII Columns": rows(f"{new} AND is_pii = 'No'"),
        "Dropped PII Columns": rows(f"{dropped} AND is_pii = 'Yes'") + side("pii_under_dropped_schema"),
        "Dropped Non PII Columns": rows(f"{dropped} AND is_pii = 'No'")
        + side("non_pii_under_dropped_schema"),
        "Datatype Changes": rows("change_type = 'Datatype Changed'"),
        "HIGH Severity": rows("severity = 'HIGH'"),
        "MEDIUM Severity": rows("severity = 'MEDIUM'"),
        "LOW Severity": rows("severity = 'LOW'"),
        "New Column Rows": rows("change_type = 'New Column Added'"),
        "Dropped Column Rows": rows("change_type = 'Column Dropped'"),
    }
    columns = ", ".join(f'CAST({value} AS BIGINT) AS "{name}"' for name, value in values.items())
    return f"metrics AS (SELECT {columns} FROM drift)"


def _summary() -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {METRICS.index(m) + 1} AS ord, '{m}' AS metric, "
        f'"{m}" AS count FROM metrics'
        for section, names in SECTIONS.items()
        for m in names
    )


def _totals() -> str:
    parts = {
        "Database changes": ("New Databases", "Dropped Databases"),
        "Schema changes": ("New Schemas", "Dropped Schemas"),
        "Table changes": ("New Tables", "Dropped Tables"),
        "Column changes": SECTIONS["COLUMN LEVEL"],
        "New column rows": ("New Column Rows",),
        "Dropped column rows": ("Dropped Column Rows",),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS total, CAST({' + '.join(f'{chr(34)}{m}{chr(34)}' for m in members)}"
        " AS BIGINT) AS count FROM metrics"
        for name, members in parts.items()
    )


def _bars(bars: tuple) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{label}' AS label, \"{metric}\" AS value, '{colour}' AS colour FROM metrics"
        for i, (label, metric, colour) in enumerate(bars, 1)
    )
    return f"""SELECT ord, label, value, colour,
        CAST(floor(value / greatest(1, max(value) OVER ()) * 100) AS INTEGER) AS width FROM ({rows})"""


def _by_pair(table: dict[str, dict[str, str]]) -> str:
    cases = " ".join(
        f"WHEN change_type = '{change}' AND is_pii = '{flag}' THEN '{value}'"
        for change, by_flag in table.items()
        for flag, value in by_flag.items()
    )
    return f"CASE {cases} END"


def _headers() -> str:
    """Header rows of both sides, the map of each connection, and the headers renamed."""
    parts = []
    for side, absent in (("prev", 1), ("curr", 0)):
        shift = "0" if side == "prev" else "CASE WHEN sheet % 5 = 0 THEN 1 ELSE 0 END"
        spelled = " ".join(
            f"WHEN {i} THEN {_list(values)}[(p + {shift}) % 4 + 1]" for i, values in enumerate(SPELLINGS, 1)
        )
        found = " UNION ALL ".join(
            f"""SELECT connection, {ord_} AS ord, '{name}' AS standard_name,
                min(CASE WHEN regexp_matches(lower({_strip('header')}), '{pattern}') THEN pos END) AS pos
            FROM {side}_h GROUP BY connection"""
            for ord_, (name, pattern) in enumerate(HEADER_PATTERNS.items(), 1)
        )
        parts.append(f"""
        {side}_h AS (
            SELECT 'sheet_' || sheet AS connection, pos, CASE pos {spelled} END AS header
            FROM (SELECT l_orderkey // 8 AS sheet, l_linenumber AS pos, min(l_partkey) AS p
                  FROM lineitem WHERE (l_orderkey // 8) % 23 <> {absent} GROUP BY 1, 2)),
        {side}_found AS ({found}),
        {side}_map AS (
            SELECT f.connection, ord, standard_name, coalesce(header, standard_name) AS actual_name, f.pos
            FROM {side}_found f LEFT JOIN {side}_h h ON f.connection = h.connection AND f.pos = h.pos),
        {side}_renamed AS (
            SELECT connection, pos, header, coalesce(
                (SELECT arg_max(standard_name, ord) FROM {side}_map m
                 WHERE m.connection = h.connection AND m.pos = h.pos AND m.actual_name <> m.standard_name),
                header) AS new_name
            FROM {side}_h h),
        {side}_counts AS (
            SELECT m.connection, m.ord, m.standard_name, count(r.pos) AS n_columns
            FROM {side}_map m LEFT JOIN {side}_renamed r
              ON m.connection = r.connection AND m.standard_name = r.new_name GROUP BY ALL)""")
    parts.append("""
        status AS (
            SELECT connection, CASE WHEN reason = '' THEN 'ok' ELSE 'failed' END AS status, reason
            FROM (
                SELECT connection, coalesce(string_agg(
                    CASE WHEN n_columns = 0 THEN side || ' lacks ' || standard_name
                         WHEN n_columns > 1 THEN side || ' doubles ' || standard_name END,
                    '; ' ORDER BY side DESC, ord), '') AS reason
                FROM (SELECT 'prev' AS side, * FROM prev_counts UNION ALL SELECT 'curr', * FROM curr_counts)
                WHERE connection IN (SELECT connection FROM prev_h)
                  AND connection IN (SELECT connection FROM curr_h)
                GROUP BY connection))""")
    return ",".join(parts)


def oracle_sql() -> dict[str, str]:
    clean, messy, headers = _sides(False), _sides(True), _headers()
    levels, drift, metrics = _levels(), _drift(), _metrics()

    def on_clean(select: str) -> str:
        return f"WITH {clean}, {levels}, {drift}, {metrics} {select}"

    def on_messy(select: str) -> str:
        return f"WITH {messy}, {levels}, {drift}, {metrics} {select}"

    def on_headers(select: str) -> str:
        return f"WITH {headers} {select}"

    drift_row = f"{KEY}, datatype, change_type, is_pii, severity, action, row_number"
    first = "row_number() OVER (PARTITION BY {} ORDER BY row_number)"
    null_parts = [f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in KEY.split(", ")]
    clean_key = ", ".join(f"{_strip(k)} AS k{i}" for i, k in enumerate(KEY.split(", ")))
    k_list = "k0, k1, k2, k3, k4"
    place = {
        "Database": "db_name", "Schema": "schema_name", "Tables": "table_name",
        "Columns": "column_name", "Datatype": "datatype", "IsPII": "is_pii_raw",
    }
    annotated = f"""
        , cleaned AS (SELECT {clean_key}, * FROM curr_raw),
        kept AS (SELECT * FROM cleaned QUALIFY {first.format(k_list)} = 1),
        first_rows AS (
            SELECT * FROM c_db
            QUALIFY row_number() OVER (PARTITION BY {SCHEMA} ORDER BY row_number, table_name, column_name) = 1),
        marks AS (
            SELECT {KEY}, change_type, is_pii, severity, action FROM drift
            WHERE row_number IS NOT NULL AND change_type <> 'New Database Added'
            UNION ALL
            SELECT f.connection, f.db_name, f.schema_name, f.table_name, f.column_name,
                   d.change_type, d.is_pii, d.severity, d.action
            FROM first_rows f JOIN drift d USING ({SCHEMA}) WHERE d.change_type = 'New Database Added')
        SELECT k0 AS connection, k.db_name, k.schema_name, k.table_name, k.column_name,
               k.datatype, k.is_pii_raw, k.row_number,
               m.change_type, m.severity, m.action, {_by_pair(HIGHLIGHTS)} AS fill
        FROM kept k LEFT JOIN marks m ON k0 = m.connection AND k1 = m.db_name
            AND k2 = m.schema_name AND k3 = m.table_name AND k4 = m.column_name"""
    found = {
        "inventory_scan": on_clean(
            f"SELECT 'prev' AS side, {ALL} FROM prev_raw UNION ALL SELECT 'curr', {ALL} FROM curr_raw"
        ),
        "connections": on_messy("SELECT DISTINCT connection FROM curr_s"),
        "common_connections": on_messy(
            "SELECT connection FROM prev_s WHERE connection IS NOT NULL "
            "INTERSECT SELECT connection FROM curr_s"
        ),
        "unmatched_connections": on_messy(
            "SELECT DISTINCT connection, 'prev' AS side FROM prev_s ANTI JOIN curr_s USING (connection) "
            "WHERE connection IS NOT NULL UNION ALL "
            "SELECT DISTINCT connection, 'curr' AS side FROM curr_s ANTI JOIN prev_s USING (connection) "
            "WHERE connection IS NOT NULL"
        ),
        "snapshot_checks": on_headers("""
            , common AS (
                SELECT 'sheet_' || (l_orderkey // 8) AS connection FROM lineitem
                WHERE (l_orderkey // 8) % 23 <> 1
                INTERSECT
                SELECT 'sheet_' || (l_orderkey // 8) AS connection FROM lineitem
                WHERE (l_orderkey // 8) % 23 <> 0),
            valid AS (SELECT DISTINCT connection FROM prev_h WHERE lower(header) LIKE '%database%'
                      OR lower(header) LIKE '%db%')
            SELECT count(*) AS common_connections, count(v.connection) AS valid_connections,
                   count(v.connection) > 0 AS passed
            FROM common LEFT JOIN valid v USING (connection)"""),
        "row_positions": """
            SELECT connection, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                1 + row_number() OVER (PARTITION BY connection ORDER BY l_orderkey, l_linenumber,
                                       l_partkey, l_suppkey, l_extendedprice) AS row_number
            FROM (SELECT *, 'conn_' || (l_orderkey % 4) AS connection FROM lineitem)""",
        "header_map": on_headers(
            "SELECT connection, ord, standard_name, actual_name, pos FROM curr_map"
        ),
        "header_rename": on_headers("SELECT connection, pos, header, new_name FROM curr_renamed"),
        "header_conflicts": on_headers(
            "SELECT connection, standard_name, n_columns, "
            "CASE WHEN n_columns = 0 THEN 'missing' ELSE 'doubled' END AS conflict "
            "FROM curr_counts WHERE n_columns <> 1"
        ),
        "connection_status": on_headers("SELECT connection, status, reason FROM status"),
        "sheet_inventory": on_headers(f"""
            , places AS (
                SELECT connection,
                    {', '.join(f"min(pos) FILTER (WHERE new_name = '{n}') AS {c}" for n, c in place.items())}
                FROM curr_renamed
                WHERE connection NOT IN (SELECT connection FROM curr_counts WHERE n_columns <> 1)
                GROUP BY connection)
            SELECT connection,
                {', '.join(f"'v' || {c} || '_' || (l_partkey % 50) AS {c}" for c in place.values())},
                l_partkey * {POSITION_STEP} + l_suppkey % {POSITION_STEP} AS row_number
            FROM lineitem JOIN places ON connection = 'sheet_' || (l_orderkey // 8)"""),
        "clean_strip": on_messy(f"SELECT {ALL} FROM curr_s"),
        "normalise_pii": on_messy(
            f"SELECT is_pii_raw, {_flag('is_pii_raw')} AS is_pii, count(*) AS n_rows FROM curr_raw GROUP BY ALL"
        ),
        "dedup_first": on_messy(f"SELECT {ALL} FROM curr_s QUALIFY {first.format(KEY)} = 1"),
        "clean_all": on_messy(f"SELECT {ALL}, is_pii FROM curr_s QUALIFY {first.format(KEY)} = 1"),
        "clean_strip_mode": on_messy(f"SELECT {ALL}, is_pii FROM curr_s"),
        "clean_dedup_mode": on_messy(f"SELECT {ALL} FROM curr_raw QUALIFY {first.format(KEY)} = 1"),
        "duplicates": on_messy(
            f"SELECT {ALL}, is_pii, count(*) AS n_removed "
            f"FROM (FROM curr_s QUALIFY {first.format(KEY)} > 1) GROUP BY ALL"
        ),
        "rejected_rows": on_messy(" UNION ALL ".join(
            f"SELECT '{side}' AS side, {ALL}, 'null ' || concat_ws(', ', {', '.join(null_parts)}) AS reason "
            f"FROM {side}_s WHERE connection IS NULL OR db_name IS NULL OR schema_name IS NULL "
            "OR table_name IS NULL OR column_name IS NULL"
            for side in ("prev", "curr")
        )),
        "presence": on_clean(f"""
            , missing AS (
                SELECT {KEY}, 'connection' AS missing FROM prev_d ANTI JOIN curr_d USING (connection)
                UNION ALL SELECT {KEY}, 'connection' FROM curr_d ANTI JOIN prev_d USING (connection)
                {' '.join(
                    f"UNION ALL SELECT {KEY}, '{level}' FROM {x}_{short}"
                    for x in "pc"
                    for level, short in (("database", "db"), ("schema", "schema"), ("table", "table"), ("column", "column"))
                )})
            SELECT {KEY}, p.row_number IS NOT NULL AS in_prev, c.row_number IS NOT NULL AS in_curr, missing
            FROM prev_d p FULL JOIN curr_d c USING ({KEY}) LEFT JOIN missing USING ({KEY})"""),
        "pii_bubble_up": on_clean(
            f"SELECT {SCHEMA}, CASE WHEN bool_or(is_pii = 'Yes') THEN 'Yes' ELSE 'No' END AS has_pii "
            f"FROM prev_d GROUP BY {SCHEMA}"
        ),
        "severity_matrix": on_clean(
            "SELECT change_type, is_pii, severity, action, count(*) AS n_rows FROM drift GROUP BY ALL"
        ),
        "drift_all": on_clean(f"SELECT {drift_row} FROM drift"),
        "drift_all_messy": on_messy(f"SELECT {drift_row} FROM drift"),
        "side_counts": on_clean("SELECT * FROM side"),
        "drift_summary": on_clean(_summary()),
        "drift_summary_messy": on_messy(_summary()),
        "change_totals": on_clean(_totals()),
        "bars_by_change": on_clean(f"SELECT * FROM ({_bars(CHANGE_BARS)}) WHERE value > 0"),
        "bars_by_severity": on_clean(_bars(SEVERITY_BARS)),
        "highlight": on_clean(f"SELECT {drift_row}, {_by_pair(HIGHLIGHTS)} AS fill FROM drift"),
        "annotated_inventory": on_messy(annotated),
        "dropped_section": on_clean(
            f"SELECT {KEY}, datatype, is_pii, change_type, severity, action, {_by_pair(HIGHLIGHTS)} AS fill "
            "FROM drift WHERE contains(change_type, 'Dropped')"
        ),
        "drift_sorted": on_clean(f"SELECT {drift_row} FROM drift ORDER BY connection, change_type, {KEY}"),
        "critical_changes": on_clean(
            f"SELECT {KEY}, datatype, change_type, is_pii, severity, action FROM drift WHERE severity = 'HIGH'"
        ),
        "critical_tint": on_clean(
            f"SELECT {KEY}, is_pii, change_type, severity, action, "
            f"coalesce({_by_pair(TINTS)}, '#ffffff') AS tint FROM drift WHERE severity = 'HIGH'"
        ),
        "drift_by_connection": on_clean(
            "SELECT connection, change_type, severity, count(*) AS n_changes FROM drift GROUP BY ALL"
        ),
        "run_status": f"""WITH {clean}, {levels}, {drift}, {headers},
            counts AS (SELECT (SELECT count(*) FROM drift) AS drift_rows,
                              (SELECT count(*) FROM status WHERE status = 'failed') AS failed_connections)
            SELECT *, CASE WHEN failed_connections > 0 THEN 3 WHEN drift_rows > 0 THEN 1 ELSE 0 END AS status
            FROM counts""",
    }
    for level, name, key in (
        ("database", "db", DB), ("schema", "schema", SCHEMA), ("table", "table", TABLE), ("column", "column", KEY)
    ):
        found[f"{level}s_new"] = on_clean(f"SELECT DISTINCT {key} FROM c_{name}")
        found[f"{level}s_dropped"] = on_clean(f"SELECT DISTINCT {key} FROM p_{name}")
        found[f"{level}s_common"] = on_clean(f"SELECT {key} FROM prev_d INTERSECT SELECT {key} FROM curr_d")
    for query, change in (
        ("drift_new_database", "New Database Added"),
        ("drift_dropped_database", "Database Dropped"),
        ("drift_new_schema", "New Schema Added"),
        ("drift_dropped_schema", "Schema Dropped"),
        ("drift_new_table", "New Table Added"),
        ("drift_dropped_table", "Table Dropped"),
        ("drift_new_column", "New Column Added"),
        ("drift_dropped_column", "Column Dropped"),
        ("drift_datatype_changed", "Datatype Changed"),
    ):
        found[query] = on_clean(f"SELECT {drift_row} FROM drift WHERE change_type = '{change}'")
    found["sheet_reader"] = on_clean(f"SELECT {KEY}, datatype, is_pii_raw, 'x' AS owner FROM curr_raw")
    found["sheet_reader_positions"] = on_clean(
        "SELECT connection, count(*) AS n_rows, 2::BIGINT AS first, count(*) + 1 AS last, "
        "(count(*) * (count(*) + 3) // 2)::BIGINT AS total FROM curr_raw GROUP BY connection"
    )
    dropped = on_messy(
        f"SELECT {KEY}, datatype, is_pii AS is_pii_raw, change_type, severity, action, {_by_pair(HIGHLIGHTS)} AS fill "
        "FROM drift WHERE contains(change_type, 'Dropped')"
    )
    found["annotated_report"] = (
        "SELECT *, 'inventory' AS row_kind, 'o' || (row_number % 7) AS owner "
        f"FROM ({found['annotated_inventory']}) UNION ALL BY NAME SELECT *, 'dropped' AS row_kind FROM ({dropped})"
    )
    cells = ["db_name", "schema_name", "table_name", "column_name", "datatype", "is_pii_raw", "change_type", "severity", "action"]
    line = " || '|' || ".join(f"coalesce({c}, '')" for c in cells)
    dropped = found["dropped_section"].replace("is_pii, change_type", "is_pii AS is_pii_raw, change_type")
    found["report_workbook"] = (
        f"SELECT connection, rtrim({line}, '|') AS cells FROM ({on_clean(annotated)}) UNION ALL "
        f"SELECT connection, rtrim({line}, '|') FROM ({dropped}) UNION ALL SELECT DISTINCT connection, '=== DROPPED ===' FROM ({dropped})"
    )
    strip_all = ", ".join(f"{_strip(c) if c == 'connection' else c} AS {c}" for c in KEY.split(", "))
    found["workbook_reader"] = on_messy(f"SELECT {strip_all}, datatype, is_pii_raw, 'x & <y>' AS owner FROM curr_raw WHERE connection IS NOT NULL")
    shown = "".join(f" || '<td>' || {_escaped(c)} || '</td>'" for c in (*KEY.split(", "), "is_pii", "change_type", "severity", "action"))
    found["critical_pages"] = f"""
        SELECT connection, page, count(*) AS n_rows,
               '{pages.PAGE_START}Critical changes of ' || {_escaped("connection")} || ', page ' || page || '{pages.BODY_START}{pages.TABLE_START}'
               || string_agg(line, chr(10) ORDER BY place) || '{pages.TABLE_END}{pages.PAGE_END}' AS html
        FROM (SELECT connection, place, (place - 1) // {pages.ROWS_PER_PAGE} + 1 AS page,
                     '<tr style="background:' || tint || '">'{shown} || '</tr>' AS line
              FROM (SELECT *, row_number() OVER (PARTITION BY connection ORDER BY change_type, db_name, schema_name, table_name, column_name) AS place
                    FROM ({found["critical_tint"]})))
        GROUP BY connection, page"""
    return found


def _escaped(column: str) -> str:
    out = f"coalesce({column}, '')"
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{sign}', '{name}')"
    return out
