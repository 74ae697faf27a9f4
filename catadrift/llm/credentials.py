"""Secret scans with multipart credential linking, with built-in functions only.

Base kinds are found on their own: `assign` (a named secret with a value of 8 characters or more), `access` (an access
identifier) and `hex` (32 hexadecimal digits or more). Weak kinds say little alone: `login` (a named user), `key` (a run
of exactly 40 base-64 characters outside base spans) and `endpoint` (an address with a scheme). A weak span is reported
only when the parts that complete it stand in its scope, `scope` code points before or after it:

    key       an identifier: access or login
    login     a secret: assign, hex or key
    endpoint  an identifier and a secret

Spans are placed without Python: the pieces between the matches and the matches themselves alternate, so starts are
running sums of their lengths. Parts are joined with the intervals in their scope by a sweep over each document's parts
in order of place, which compares a part with the nearest one of a kind on either side instead of with all.

Edge cases: a null text is empty; a text without matches has no spans; rows that are equal give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leaks import let

KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
BASE = KINDS[:3]
SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOGIN = r"""(?i)(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(?i)(https?|ftps?|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqps?|ldaps?|ssh)://[^\x20\x09-\x0D"'<>]+"""
SPAN = "array<struct<start:bigint,end:bigint>>"
PIECE = 64


def running(lengths: Column) -> Column:
    """Sums of the elements before each one, in pieces so that long arrays stay cheap."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

    def sums(v: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int"))
        heads = F.aggregate(
            pieces, F.array(F.lit(0).cast("long")),
            lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + total(F.slice(v, p * PIECE + 1, PIECE)))),
        )
        return let(heads, lambda h: F.transform(v, lambda x, i: F.get(h, F.floor(i / PIECE).cast("int")) + total(F.slice(v, (F.floor(i / PIECE) * PIECE + 1).cast("int"), i % PIECE))))

    return F.when(F.size(lengths) > 0, let(lengths, sums)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """Spans (start, end) of the leftmost non-overlapping matches, in code points; keep(length of the group) may drop some."""

    def place(pair: Column) -> Column:
        steps = F.zip_with(pair.found, F.slice(pair.rest, 1, F.size(pair.found)), lambda m, b: F.length(b).cast("long") + F.length(m).cast("long"))
        spans = let(running(steps), lambda before: F.transform(
            pair.found,
            lambda m, i: F.struct(
                (F.get(before, i) + F.length(F.get(pair.rest, i)).cast("long")).alias("start"),
                (F.get(before, i) + F.length(F.get(pair.rest, i)).cast("long") + F.length(m).cast("long")).alias("end"),
                F.length(F.get(pair.value, i)).alias("size"),
            ),
        ))
        spans = spans if keep is None else F.filter(spans, lambda s: keep(s.size))
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pair = F.struct(found.alias("found"), value.alias("value"), F.split(text, pattern, -1).alias("rest"))
    return F.when(F.rlike(text, F.lit(pattern)), let(pair, place)).otherwise(F.array().cast(SPAN))


def parts(spans: dict[str, Column]) -> Column:
    """One array of (start, end, kind), kind as its place in KINDS."""

    def one(kind: str, column: Column) -> Column:
        return F.transform(column, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s.end.alias("end")))

    return F.concat(*[one(kind, column) for kind, column in spans.items()])


def linked(rows: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """The weak parts whose complement is in scope. rows: keys, start, end, kind."""
    number = {kind: i for i, kind in enumerate(KINDS)}
    order = Window.partitionBy(*keys).orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    for role, kinds in {"identifier": ("access", "login"), "secret": ("assign", "hex", "key")}.items():
        mine = F.col("kind").isin([number[k] for k in kinds])
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before)
        right = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end")
        rows = rows.withColumn(role, F.coalesce(left <= scope, F.lit(False)) | F.coalesce(right <= scope, F.lit(False)))
    need = {"key": F.col("identifier"), "login": F.col("secret"), "endpoint": F.col("identifier") & F.col("secret")}
    told = F.lit(False)
    for kind, rule in need.items():
        told = told | ((F.col("kind") == number[kind]) & rule)
    return rows.where(told).select(*keys, F.struct("start", "kind", "end").alias("part"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: key, base (array of start, kind, end), spans (base and linked weak ones), both by place."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = {
        "assign": matches(body, ASSIGN, lambda n: n >= 8, group=2), "access": matches(body, ACCESS), "hex": matches(body, HEX),
    }
    mine = docs.select(
        F.col(key).alias("id"), F.xxhash64(key, text).alias("h1"), F.xxhash64(F.lit(1), key, text).alias("h2"), body.alias("body"),
        F.array_sort(parts(base)).alias("base"),
    )

    def weak(row: Column) -> Column:
        clear = F.filter(matches(row.body, KEY, lambda n: n == 40), lambda s: ~F.exists(row.base, lambda b: (b.start <= s.start) & (s.end <= b.end)))
        return parts({"login": matches(row.body, LOGIN), "key": clear, "endpoint": matches(row.body, ENDPOINT)})

    mine = mine.withColumn("weak", let(F.struct("body", "base"), weak)).drop("body")
    few = mine.where(F.size("weak") > 0).select("id", "h1", "h2", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("part"))
    few = few.select("id", "h1", "h2", "part.*").distinct()  # rows that are equal link as one
    more = linked(few, ["id", "h1", "h2"], scope).groupBy("id", "h1", "h2").agg(F.collect_list("part").alias("more"))
    more = more.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "more")
    out = mine.drop("weak").join(more, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select(
        F.col("id").alias(key), "base",
        F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))).alias("spans"),
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == KINDS.index(kind))).cast("long")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[count(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )
