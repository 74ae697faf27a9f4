"""Hand-made snapshots; see FIXTURES.md, section 2."""

SCHEMA = (
    "connection STRING, db_name STRING, schema_name STRING, table_name STRING, "
    "column_name STRING, datatype STRING, is_pii_raw STRING, row_number BIGINT"
)

PREVIOUS = """
A_DB|dbo|Customer|Email|VARCHAR|Yes
A_DB|dbo|Customer|CustomerID|INT|No
 A_DB |dbo|Customer|Email|TEXT|no
A_DB|dbo|Customer|Phone|CHAR(10)|y
A_DB|dbo|Customer|Notes|TEXT|maybe
A_DB|dbo|Orders|OrderID|INT|0
A_DB|dbo|Orders|Amount|DECIMAL|no
A_DB|dbo|Cards|PAN|CHAR(16)|PII
A_DB|dbo|Cards|Expiry|DATE|n
A_DB|hr|Staff|SSN|CHAR(11)|TRUE
A_DB|hr|Staff|Grade|INT|No
A_DB|tmp|T1|c1|INT|No
B_DB|s1|t|p|INT|Yes
B_DB|s2|t|q|INT|No
"""
CURRENT = """
A_DB|dbo|Customer|Email|VARCHAR|No
A_DB|dbo|Customer|CustomerID|BIGINT|No
A_DB|dbo|Customer|Notes|CLOB|1
A_DB|dbo|Customer|CustomerID|INT|No
A_DB|dbo|Customer|DOB|DATE|Yes
A_DB|dbo|Customer|Tier|INT|unk
A_DB|dbo|Invoice|InvID|INT|No
A_DB|dbo|Invoice|TaxID|VARCHAR|Yes
A_DB|mkt|Lead|Email|VARCHAR|Yes
A_DB|mkt|Click|Url|VARCHAR|No
C_DB|x|t1|a|INT|No
C_DB|x|t1|b|INT|Yes
C_DB|y|t2|c|INT|No
"""


def rows(text, connection="CRM"):
    lines = text.strip("\n").split("\n")
    return [(connection, *line.split("|"), n) for n, line in enumerate(lines, 2)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def golden_pair(spark):
    prev = rows(PREVIOUS) + [("OLD", "d", "s", "t", "c", "INT", "Yes", 2)]
    curr = rows(CURRENT) + [("NEW", "d", "s", "t", "c", "INT", "Yes", 2)]
    return frame(spark, prev), frame(spark, curr)
