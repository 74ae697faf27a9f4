"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catadrift.config import DEFAULT, NO, UNKNOWN, YES, DriftConfig

# Every character Unicode counts as whitespace, plus the four ASCII separators 1C-1F.
# Spark's one-argument trim removes spaces only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _literals(values: tuple[str, ...] | str) -> str:
    quoted = [value.replace("\\", "\\\\").replace("'", "\\'") for value in values]
    return ", ".join(f"'{value}'" for value in quoted)


def _stripped(name: str) -> str:
    edges = _literals(WHITESPACE)
    return (
        f"CASE WHEN substring({name}, 1, 1) IN ({edges}) OR substring({name}, -1, 1) IN ({edges}) "
        f"THEN btrim({name}, '{WHITESPACE}') ELSE {name} END"
    )


def strip(name: str) -> Column:
    """A text column without whitespace of any kind at its ends.

    Catalog names are rarely padded, so the edges are tested before the far dearer trim.
    """
    return F.expr(_stripped(name)).alias(name)


def normalise_pii(name: str, config: DriftConfig = DEFAULT, stripped: bool = False) -> Column:
    """Yes, No or Unknown from any spelling of the personal-data flag; null is Unknown."""
    flag = f"lower({name if stripped else _stripped(name)})"
    return F.expr(
        f"CASE WHEN {flag} IN ({_literals(config.yes_values)}) THEN '{YES}' "
        f"WHEN {flag} IN ({_literals(config.no_values)}) THEN '{NO}' ELSE '{UNKNOWN}' END"
    )


def lookup(table: dict[str, dict[str, str]], change_type: str, flag: str) -> Column:
    """Value of a small fixed table for (change type, flag); null where it has none."""
    pairs = [
        F.lit(part)
        for change, by_flag in table.items()
        for name, value in by_flag.items()
        for part in (f"{change}/{name}", value)
    ]
    return F.element_at(F.create_map(*pairs), F.concat_ws("/", change_type, flag))
