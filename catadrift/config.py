"""Settings of a comparison and the fixed values its results are made of."""

from __future__ import annotations

from dataclasses import dataclass, field

# Key of a cataloged column, and the key of every level above it.
TABLE_KEY = ["connection", "db_name", "schema_name", "table_name"]
KEY = [*TABLE_KEY, "column_name"]
NAMES = KEY[1:]

# A cataloged snapshot: one row per database column.
INVENTORY = [*KEY, "datatype", "is_pii_raw", "row_number"]

DRIFT = [
    "connection", "db_name", "schema_name", "table_name", "column_name", "datatype",
    "change_type", "is_pii", "severity", "action", "row_number",
]

# --------------------------------------------------------------------------------------
# Words, texts, patterns and colours that appear in results as they are here.
# --------------------------------------------------------------------------------------

# Standard headers, in detection order, with the pattern looked for in a lowercase header.
HEADER_PATTERNS = {
    "Database": "database|dbname|db_name",
    "Schema": "schema|schema_name|db_schema|dbschema",
    "Tables": "table|tbl|table_name",
    "Columns": "column|col|field|column_name",
    "Datatype": "datatype|data_type|dtype|type",
    "IsPII": "ispii|is_pii|pii|sensitive",
}

# Spellings of the personal-data flag; anything else is Unknown.
YES_VALUES = ("yes", "y", "true", "1", "pii")
NO_VALUES = ("no", "n", "false", "0", "non-pii", "nonpii")
YES, NO, UNKNOWN = "Yes", "No", "Unknown"

NOT_APPLICABLE = "N/A"
ARROW = " → "
NULL_TEXT = "nan"

# Change types.
NEW_DATABASE = "New Database Added"
DROPPED_DATABASE = "Database Dropped"
NEW_SCHEMA = "New Schema Added"
DROPPED_SCHEMA = "Schema Dropped"
NEW_TABLE = "New Table Added"
DROPPED_TABLE = "Table Dropped"
NEW_COLUMN = "New Column Added"
DROPPED_COLUMN = "Column Dropped"
DATATYPE_CHANGED = "Datatype Changed"

NEW_TYPES = (NEW_COLUMN, NEW_TABLE, NEW_SCHEMA, NEW_DATABASE)
DROPPED_TYPES = (DROPPED_COLUMN, DROPPED_TABLE, DROPPED_SCHEMA, DROPPED_DATABASE)

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"

# Recommended action: (with personal data, without).
ACTIONS = {
    NEW_DATABASE: (
        "Scan entire database — PII analysis required",
        "Scan entire database — PII analysis required",
    ),
    DROPPED_DATABASE: (
        "Database dropped — PII data detected — verify removal — deactivate all masking routines",
        "Database dropped — verify removal — deactivate masking routines",
    ),
    NEW_SCHEMA: (
        "New schema — PII analysis required — raise change request",
        "New schema — PII analysis required — raise change request",
    ),
    DROPPED_SCHEMA: (
        "Schema dropped — PII columns detected — verify removal — deactivate masking routines",
        "Schema dropped — verify removal — deactivate masking routines",
    ),
    NEW_TABLE: (
        "New table — scan all columns — add PII to masking scope",
        "New table — scan all columns — add PII to masking scope",
    ),
    DROPPED_TABLE: (
        "Table dropped — PII columns detected — verify removal — deactivate masking routines",
        "Table dropped — verify removal — deactivate masking routines",
    ),
    NEW_COLUMN: ("Add to masking scope immediately", "Review required"),
    DROPPED_COLUMN: (
        "Column dropped — PII detected — verify removal — update masking scope",
        "Column dropped — verify removal",
    ),
    DATATYPE_CHANGED: ("Review required", "Review required"),
}

# Highlight of a row in the annotated snapshot (ARGB) by change type and flag.
RED, YELLOW, ORANGE = "FFFF0000", "FFFFFF00", "FFFFA500"
BLUE, PURPLE = "FFADD8E6", "FFDDA0DD"
HIGHLIGHTS = {
    NEW_COLUMN: {"Yes": RED, "No": YELLOW},
    NEW_TABLE: {"Yes": RED, "No": YELLOW},
    NEW_SCHEMA: {"Yes": RED, "No": YELLOW, "Unknown": RED},
    NEW_DATABASE: {"Yes": RED, "No": YELLOW, "Unknown": RED},
    DROPPED_COLUMN: {"Yes": ORANGE, "No": BLUE},
    DROPPED_TABLE: {"Yes": ORANGE, "No": BLUE, "N/A": BLUE},
    DROPPED_SCHEMA: {"Yes": ORANGE, "No": BLUE, "N/A": BLUE},
    DROPPED_DATABASE: {"Yes": ORANGE, "No": BLUE, "N/A": BLUE},
    DATATYPE_CHANGED: {"Yes": RED, "No": PURPLE},
}

# Tint of a row in the critical-changes table by change type and flag.
TINTS = {
    NEW_COLUMN: {"Yes": "#ffe0e0", "No": "#fffde0"},
    NEW_TABLE: {"Yes": "#ffe0e0", "No": "#fffde0"},
    NEW_SCHEMA: {"Yes": "#ffe0e0", "No": "#fffde0", "Unknown": "#ffe0e0"},
    NEW_DATABASE: {"Unknown": "#ffe0e0"},
    DROPPED_COLUMN: {"Yes": "#fff0e0", "No": "#e8f4fb"},
    DROPPED_TABLE: {"Yes": "#fff0e0", "No": "#e8f4fb"},
    DROPPED_SCHEMA: {"Yes": "#fff0e0", "No": "#e8f4fb"},
    DROPPED_DATABASE: {"Yes": "#fff0e0", "No": "#e8f4fb"},
    DATATYPE_CHANGED: {"Yes": "#ffe0e0", "No": "#f5e6ff"},
}
DEFAULT_TINT = "#ffffff"

# Title above the dropped rows of a report sheet.
DROPPED_TITLE = "=== DROPPED ==="

# Sections of the drift summary and the metrics in them, in report order.
SECTIONS = {
    "DATABASE LEVEL": ("New Databases", "Dropped Databases"),
    "SCHEMA LEVEL": ("New Schemas", "Dropped Schemas"),
    "TABLE LEVEL": ("New Tables", "Dropped Tables"),
    "COLUMN LEVEL": (
        "New PII Columns", "New Non PII Columns", "Dropped PII Columns",
        "Dropped Non PII Columns", "Datatype Changes",
    ),
    "SEVERITY": ("HIGH Severity", "MEDIUM Severity", "LOW Severity"),
}
METRICS = tuple(m for metrics in SECTIONS.values() for m in metrics)

# Bars of the change chart: label, metric, colour.
CHANGE_BARS = (
    ("New PII", "New PII Columns", "#e74c3c"),
    ("Dropped PII", "Dropped PII Columns", "#3498db"),
    ("Datatype Changed", "Datatype Changes", "#9b59b6"),
    ("New Table", "New Tables", "#e67e22"),
    ("Table Dropped", "Dropped Tables", "#2980b9"),
    ("New Schema", "New Schemas", "#f39c12"),
    ("Schema Dropped", "Dropped Schemas", "#8e44ad"),
    ("New Database", "New Databases", "#f39c12"),
    ("Database Dropped", "Dropped Databases", "#8e44ad"),
)
SEVERITY_BARS = (
    ("HIGH", "HIGH Severity", "#e74c3c"),
    ("MEDIUM", "MEDIUM Severity", "#e67e22"),
    ("LOW", "LOW Severity", "#27ae60"),
)

# Run status.
NO_DRIFT, DRIFT_FOUND, RUN_FAILED, PARTIAL_RUN = 0, 1, 2, 3


@dataclass(frozen=True)
class DriftConfig:
    """What a user may change: flag spellings, header patterns, colours."""

    yes_values: tuple[str, ...] = YES_VALUES
    no_values: tuple[str, ...] = NO_VALUES
    header_patterns: dict[str, str] = field(default_factory=lambda: dict(HEADER_PATTERNS))
    highlights: dict[str, dict[str, str]] = field(default_factory=lambda: dict(HIGHLIGHTS))
    tints: dict[str, dict[str, str]] = field(default_factory=lambda: dict(TINTS))


DEFAULT = DriftConfig()
