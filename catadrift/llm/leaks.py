"""Benchmark decontamination by winnowing, with built-in functions only.

Texts are cut into words; a window is `window` consecutive words of an item, or all of a shorter item. The fingerprint of
a window is the smallest hash among its `gram`-word sequences, so a document that holds the window holds that
fingerprint at the same place: no shared span of `window` words is missed.

1. The fingerprints of the benchmark go into a bit field of fixed size (BITS bits, whatever the benchmark's size). It is
   a constant of the plan, and lets a document's windows pass that may be in the benchmark.
2. These join the benchmark's windows on the fingerprint; a hit is extended to the whole window by comparing its words.
   Windows that many items share are one row with a set of items, so a common passage does not multiply.
3. One aggregate per document counts the words inside hits and gathers the items.

Edge cases: a null or empty text has no words and is clean; an item without words has no window, one with a null id hits
but is not listed; item rows that share an id are one item; equal document rows give equal result rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 10, 5
#: Size of the bit field: 2**19 bits, 64 KB.
BITS = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for a null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(cut, lambda x: x != "")


def _steps(last: Column) -> Column:
    """1 to last; empty below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once; a plain column would be worked out for each element of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(hashes: Column, width: int, gram: int) -> Column:
    """The smallest gram hash of every run of `width` words, by start. The hashes should be bound by let()."""
    gram = min(gram, width)
    grams = F.transform(_steps(F.size(hashes) - gram + 1), lambda i: F.xxhash64(F.slice(hashes, i, gram)))
    if width == gram:
        return grams
    count = width - gram + 1
    return let(grams, lambda g: F.transform(_steps(F.size(g) - count + 1), lambda i: F.array_min(F.slice(g, i, count))))


def windows(tokens: Column, width: int, gram: int, passes=None) -> Column:
    """start (from 1), width, mark (fingerprint) and span (its words) of the windows whose fingerprint passes."""

    def one(w: Column, x: Column, i: Column) -> Column:
        row = F.struct(
            (i + 1).alias("start"), F.lit(width).alias("width"), x.alias("mark"), F.array_join(F.slice(w, i + 1, width), " ").alias("span")
        )
        return row if passes is None else F.when(passes(x), row)

    return let(tokens, lambda w: let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.filter(F.transform(fingerprints(h, width, gram), lambda x, i: one(w, x, i)), lambda r: r.isNotNull()),
    ))


def item_windows(benchmark: DataFrame, item: str, text: str, window: int, gram: int) -> DataFrame:
    """width, mark (fingerprint), span (its words), items: one row per distinct window."""
    base = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    found = windows(F.col("w"), window, gram)
    for width in range(1, window):  # shorter items are one window each
        found = F.when(F.size("w") == width, windows(F.col("w"), width, gram)).otherwise(found)
    rows = base.select("item", F.explode(found).alias("r"))
    rows = rows.select("item", "r.width", "r.mark", "r.span")
    return rows.groupBy("width", "mark", "span").agg(F.collect_set("item").alias("items"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """One row per document: key, n_words, hits (start, end in words), items, n_hit."""
    known = item_windows(benchmark, item, item_text, window, gram)
    marks = known.groupBy("width", F.expr(f"pmod(mark, {BITS}) div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(mark, {BITS}) % 64 AS INT))")).alias("bits")
    )
    field = np.zeros(BITS // 64, np.int64)
    widths = set()
    for row in marks.collect():  # at most `window` times the field's size, whatever the benchmark's
        field[row.word] |= row.bits
        widths.add(row.width)
    widths = sorted(widths)
    bits = F.lit(field)

    def passes(mark: Column) -> Column:
        bit = F.pmod(mark, F.lit(BITS))
        return F.getbit(F.get(bits, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

    # the first row of a document stands for the document, hit or not
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("width"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("string").alias("span")))
    mine = docs.select(
        F.col(key).alias("id"), F.xxhash64(key, text).alias("h1"), F.xxhash64(F.lit(1), key, text).alias("h2"),
        let(words(F.col(text)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.concat(first, *[windows(w, width, gram, passes) for width in widths]).alias("at"),
        )).alias("found"),
    )
    mine = mine.select("id", "h1", "h2", "found.n_words", F.explode("found.at").alias("at")).select("id", "h1", "h2", "n_words", "at.*")
    # documents' own rows join nothing; their keys are spread, so that no task gets them all
    own = F.col("width") == 0
    mine = mine.withColumn("mark", F.when(own, F.col("h1")).otherwise(F.col("mark"))).withColumn("span", F.coalesce("span", F.lit("")))
    found = mine.join(known, ["width", "mark", "span"], "left").select(
        "id", "h1", "h2", "n_words", own.alias("own"), "items",
        F.when(F.col("items").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("width")).alias("end"))).alias("hit"),
    )
    out = found.groupBy("id", "h1", "h2", "n_words").agg(
        F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count(F.when(F.col("own"), 1)).alias("copies"),
    )
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, a.reach))).cast("long").alias("n"), F.greatest(a.reach, x.end).alias("reach")),
        lambda a: a.n,
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias(key), "n_words", "hits", "items", covered.alias("n_hit"), "h1", "h2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any benchmark window, as they are."""
    leaks = find_leaks(docs, benchmark, key, text).where("n_hit > 0").select("h1", "h2").distinct()
    return docs.join(leaks, (F.xxhash64(docs[key], docs[text]) == leaks.h1) & (F.xxhash64(F.lit(1), docs[key], docs[text]) == leaks.h2), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS span
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM d, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width)
), hits AS (
  SELECT doc_id, i, width, item_id FROM dw JOIN bw USING (width, span)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
