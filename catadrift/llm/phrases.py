"""Collocations by SON partitioning: phrases whose words stand together more often than their parts would have it.

A text is cut at punctuation and line ends into pieces, a piece at spaces and tabs into words; a phrase is a run of words
of one piece, counted by language. Counting every phrase by its text would move several times the corpus, for phrases
that occur once or twice, so they are mined first (Savasere, Omiecinski and Navathe's two passes):

1. Documents are dealt into `shards` equal parts. A phrase with `support` occurrences in all has at least support / shards
   in one of them, so what is mined completely in each shard at that lowered support misses none. A shard is mined
   level by level: each of its blocks counts its words, then two-word phrases whose words are candidates, then
   three-word phrases whose two halves are, and sends 48-bit hashes with counts. Partitions by hash add up the counts of
   a shard; candidates are the union of what is locally frequent, less those whose counts in all shards, known there by
   then, fall short of the support. The blocks are told which of their phrases are candidates.
2. All documents are read again, and the candidates counted exactly, by their text. Hashes only choose what to count: one
   that two phrases share makes a candidate too many, never one too few. Inside a block 112 bits tell phrases apart.

A block is a bounded part of an input partition, so neither a language, a document id nor a group of copies makes one
large; a frequent phrase moves once per block. Cuts, scores and the suppression of parts are joins of what is frequent.

Edge cases: a null text is empty; a null language is `und`; rows that share an id count each by itself; a language whose
phrases are all rare has no row; of equal scores and counts the phrase that sorts first (in UTF-8) comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import partitions, stored
from .texts import BASE, Spans, byte_values, flat, mix, text_lots

SUPPORT, LONGEST, TOP = 10, 3, 2000
#: Parts of the corpus that are mined by themselves, and blocks for each shuffle partition.
SHARDS, BLOCKS_PER_PARTITION = 4, 2
#: Parts of a language whose first phrases are found before those of the whole.
SALTS = 64
UNKNOWN = "und"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, and whether the next one stands in the same piece."""
    ends = np.isin(data, np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
    solid = ~ends & (data != 32) & (data != 9)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends where its text does
    start = np.flatnonzero(solid & ~(np.r_[False, solid[:-1]] & ~edge[:-1]))
    end = np.flatnonzero(solid & ~(np.r_[solid[1:], False] & ~edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    piece = np.r_[0, np.cumsum(ends)][start]
    together = np.r_[(piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False] if len(start) else np.zeros(0, bool)
    return start, end, doc, together


def language_seeds(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=np.uint64)


def longer(one: np.ndarray, together: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash (the part of it that travels, if short) of the phrase of `size` words at every word, and whether there is one."""
    code, whole = one, np.ones(len(one), bool)
    for i in range(1, size):
        whole = whole & np.r_[together[i - 1 :], np.zeros(i - 1, bool)]
        code = mix(code * np.uint64(BASE) + np.r_[one[i:], np.zeros(min(i, len(one)), np.uint64)])
    return code & CODE_BITS if short else code, whole


def among(codes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted array."""
    if not len(allowed):
        return np.zeros(len(codes), bool)
    return allowed[np.minimum(np.searchsorted(allowed, codes), len(allowed) - 1)] == codes


def summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each distinct key (the last of keys counts most), and the sum of its counts."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    cut = np.flatnonzero(new)
    return order[cut], np.add.reduceat(counts[order], cut) if len(cut) else np.zeros(0, np.int64)


SENT = "part int, block int, codes binary, counts binary"
CHOSEN = "block int, size int, codes binary"
FOUND = "part int, langs array<string>, lang binary, sizes binary, lengths binary, phrases binary, bytes long, counts binary"
COUNTED = "lang string, size int, phrase string, n long"
#: Bytes of a hash that travel.
WIDTH = 6
CODE_BITS = np.uint64((1 << 8 * WIDTH) - 1)


def planes(values: np.ndarray, width: int) -> bytes:
    """The lower bytes of numbers, all first bytes first: sorted hashes and small numbers compress well so."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(rows: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of planes, and how many each row has."""
    parts = []
    for row in rows.to_pylist():
        wide = np.zeros((len(row) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(row, np.uint8).reshape(width, -1).T
        parts.append(wide.view("<u8")[:, 0])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(x) for x in parts], dtype=np.int64)


class Blocks:
    """What happens to a block of documents (block, lang, text) in each pass."""

    def __init__(self, parts: int, longest: int):
        self.parts, self.longest = parts, longest

    @staticmethod
    def lots(docs: pa.Table):
        """Lot by lot: bytes, offset of the first, start, end and document of words, togetherness, hashes, language seeds."""
        data, offsets = flat(docs["text"])
        seeds = language_seeds(docs["lang"].to_pylist())
        for a, b in text_lots(offsets):
            body, base = data[offsets[a] : offsets[b]], offsets[a]
            start, end, doc, together = words(body, offsets[a : b + 1] - base)
            if len(start):
                seed = seeds[a + doc]
                yield body, base, start, end, a + doc, together, mix(Spans(body, byte_values(fold=True)).hash(start, end) ^ seed), seed

    def chosen(self, rows: pa.Table | None, size: int) -> np.ndarray:
        """The candidates of a size that the block has been told of."""
        if rows is None:
            return np.zeros(0, np.uint64)
        return np.unique(numbers(rows.filter(pa.array([x == size for x in rows["size"].to_pylist()], pa.bool_()))["codes"], WIDTH)[0])

    def send(self, size: int):
        """Counts of the block's phrases of a size whose shorter parts are candidates, packed by hash partition."""

        def run(docs: pa.Table, told: pa.Table | None = None) -> pa.Table:
            allowed, found = self.chosen(told, size - 1), []
            for _, _, _, _, _, together, one, _ in self.lots(docs):
                code, whole = longer(one, together, size)
                if size > 1:
                    inner = among(longer(one, together, size - 1)[0], allowed)
                    whole &= inner & np.r_[inner[1:], False]
                found.append(np.unique(code[whole], return_counts=True))
            codes = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.uint64)
            counts = np.concatenate([n for _, n in found]).astype(np.int64) if found else np.zeros(0, np.int64)
            at, counts = summed((codes,), counts)
            codes = codes[at]
            order, edge, used = self.dealt(codes)
            block = docs["block"][0].as_py() if docs.num_rows else None
            return pa.table({
                "part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()),
                "codes": pa.array([planes(codes[order[edge[p] : edge[p + 1]]], WIDTH) for p in used], pa.binary()),
                "counts": pa.array([planes(counts[order[edge[p] : edge[p + 1]]], 4) for p in used], pa.binary()),
            })

        return run

    def dealt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by partition, where each partition begins, and the partitions that have any."""
        part = (codes >> np.uint64(8)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(self.parts + 1))
        return order, edge, np.flatnonzero(np.diff(edge))

    def count(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """Exact counts of the candidates in the block, and of all words by language as size 0 (an empty phrase), packed by partition."""
        allowed = {size: self.chosen(told, size) for size in range(1, self.longest + 1)}
        langs = docs["lang"].to_pylist()
        names = sorted(set(langs))
        lang = np.searchsorted(np.array(names, dtype=object), np.array(langs, dtype=object)) if langs else np.zeros(0, np.int64)
        found, total = [], np.zeros(len(names), np.int64)
        other = mix(byte_values(fold=True) + np.uint64(1))
        for body, base, start, end, doc, together, one, seed in self.lots(docs):
            two = mix(Spans(body, other).hash(start, end) + seed)
            total += np.bincount(lang[doc], minlength=len(names))
            odd = np.r_[0, np.cumsum(start[1:] - end[:-1] != 1) + np.cumsum(body[end[:-1]] == 9)]  # separators that aren't one space
            for size, codes in allowed.items():
                code, whole = longer(one, together, size)
                at = np.flatnonzero(whole)
                at = at[among(code[at], codes)]
                if len(at):
                    check = longer(two, together, size, short=False)[0][at]
                    first, n = summed((check, code[at]), np.ones(len(at), np.int64))
                    i = at[first]
                    found.append((code[i], check[first], n, np.full(len(i), size), lang[doc[i]], start[i] + base, end[i + size - 1] + base, odd[i + size - 1] - odd[i]))
        if found:
            code, check, n, size, which, start, end, odd = (np.concatenate(x) for x in zip(*found, strict=True))
            at, n = summed((check, code, size), n)
            code, size, which, start, end, odd = (x[at] for x in (code, size, which, start, end, odd))
        else:
            code, (n, size, which, start, end, odd) = np.zeros(0, np.uint64), (np.zeros(0, np.int64) for _ in range(6))
        # the totals go to partitions by language
        code = np.r_[code, language_seeds(names) & CODE_BITS] if names else code
        n, size, which = np.r_[n, total], np.r_[size, np.zeros(len(names), np.int64)], np.r_[which, np.arange(len(names))]
        start, end, odd = (np.r_[x, np.zeros(len(names), np.int64)] for x in (start, end, odd))
        order, edge, used = self.dealt(code)
        data = flat(docs["text"])[0]
        folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        # phrases that begin alike stand together, which compresses better
        padded, head = np.r_[folded, np.zeros(8, np.uint8)].astype(np.uint64), np.zeros(len(start), np.uint64)
        for i in range(8):
            head = head << np.uint64(8) | padded[start + i]
        cut = [o[np.argsort(head[o], kind="stable")] for o in (order[edge[p] : edge[p + 1]] for p in used)]
        rows = [self.phrases(folded, start[o], end[o], odd[o] > 0) for o in cut]
        return pa.table({
            "part": pa.array(used, pa.int32()), "langs": pa.array([names] * len(used), pa.list_(pa.string())),
            "lang": pa.array([planes(which[o], 4) for o in cut], pa.binary()), "sizes": pa.array([planes(size[o], 1) for o in cut], pa.binary()),
            "lengths": pa.array([planes(length, 4) for length, _ in rows], pa.binary()),
            "phrases": pa.array([pa.compress(body, codec="zstd", asbytes=True) for _, body in rows], pa.binary()),
            "bytes": pa.array([len(body) for _, body in rows], pa.int64()), "counts": pa.array([planes(n[o], 8) for o in cut], pa.binary()),
        })

    @staticmethod
    def phrases(data: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Lengths and bytes of phrases, one after the other; `odd` ones have other separators than single spaces."""
        length = end - start
        if not odd.any():
            at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            return length, data[np.repeat(start, length) + at].tobytes()
        body = data.tobytes()
        texts = [b" ".join(body[a:b].split()) if x else body[a:b] for a, b, x in zip(start.tolist(), end.tolist(), odd.tolist(), strict=True)]
        return np.array([len(x) for x in texts], dtype=np.int64), b"".join(texts)


def add_up(support: int):
    """Counts of a partition's phrases by their text; those of `support` occurrences, and the totals of languages."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.to_pylist():
            length, _ = numbers(pa.chunked_array([pa.array([row["lengths"]], pa.binary())]), 4)
            body = pa.decompress(row["phrases"], decompressed_size=row["bytes"], codec="zstd") if row["bytes"] else pa.py_buffer(b"")
            ends = pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64).tobytes())
            phrase = pa.Array.from_buffers(pa.large_binary(), len(length), [None, ends, body])
            index, size, n = (numbers(pa.chunked_array([pa.array([row[c]], pa.binary())]), w)[0].astype(np.int64) for c, w in (("lang", 4), ("sizes", 1), ("counts", 8)))
            lang = pa.array(row["langs"], pa.string()).take(pa.array(index))
            parts.append(pa.table({"lang": lang, "size": pa.array(size, pa.int32()), "phrase": phrase, "n": pa.array(n)}))
        whole = pa.concat_tables(parts).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum")])
        n, size = whole["n_sum"].to_numpy(), whole["size"].to_numpy()
        keep = (n >= support) | (size == 0) & (n > 0)
        whole = whole.filter(pa.array(keep, pa.bool_()))
        return pa.table({"lang": whole["lang"], "size": whole["size"], "phrase": whole["phrase"].cast(pa.large_string()).cast(pa.string()), "n": whole["n_sum"]})

    return run


def candidates(size: int, shards: int, least: int, support: int):
    """For a partition's hashes: tells each block which of its phrases occur `least` times in some shard and `support` times in all."""

    def run(table: pa.Table) -> pa.Table:
        codes, lengths = numbers(table["codes"], WIDTH)
        counts = numbers(table["counts"], 4)[0].astype(np.int64)
        block = table["block"].to_numpy()
        shard = np.repeat(block % shards, lengths)
        at, local = summed((shard, codes), counts)
        union = np.unique(codes[at[local >= least]])
        mine = among(codes[at], union)
        one, total = summed((codes[at[mine]],), local[mine])
        allowed = codes[at[mine]][one][total >= support]
        hit = among(codes, allowed)
        edge = np.r_[0, np.cumsum(lengths)]
        rows = [(int(b), planes(codes[x:y][hit[x:y]], WIDTH)) for b, x, y in zip(block, edge[:-1], edge[1:], strict=True) if hit[x:y].any()]
        return pa.table({
            "block": pa.array([b for b, _ in rows], pa.int32()), "size": pa.array([size] * len(rows), pa.int32()), "codes": pa.array([c for _, c in rows], pa.binary()),
        })

    return run


def phrase_counts(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text: str = "text", lang: str = "lang", shards: int = SHARDS,
) -> DataFrame:
    """lang, size, phrase and n of all phrases of up to `longest` words with `support` occurrences; size 0 has all words of a language."""
    count = partitions(docs.sparkSession)
    parts, blocks = max(1, count // 2), shards * max(1, -(-BLOCKS_PER_PARTITION * count // shards))
    plain = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    # the place in the input spreads copies too; it is the same however often a partition is read
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = plain.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int"))
    work, least = Blocks(parts, longest), -(-support // shards)
    told = last = None
    for size in range(1, longest + 1):
        if last is None:
            sent = dealt.groupBy("block").applyInArrow(_alone(work.send(size)), SENT)
        else:
            sent = dealt.groupBy("block").cogroup(last.groupBy("block")).applyInArrow(_paired(work.send(size)), SENT)
        last = sent.groupBy("part").applyInArrow(candidates(size, shards, least, support), CHOSEN)
        told = last if told is None else told.unionByName(last)
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: work.count(d, t), FOUND)
    return found.groupBy("part").applyInArrow(add_up(support), COUNTED)


def _alone(f):
    return lambda docs: f(docs)


def _paired(f):
    return lambda docs, told: f(docs, told)


def part(first, size) -> F.Column:
    """Words of a phrase, as text."""
    return F.array_join(F.slice(F.col("words"), first, size), " ")


def collocations(counts: DataFrame, top: int = TOP, kept: int = 50) -> DataFrame:
    """Each language's first `top` phrases by score, from phrase_counts(); parts of phrases at least `kept` % as frequent go.

    Columns lang, rank, phrase, a (occurrences), l and r (those of the parts of the weakest cut), n (words of the
    language) and score, floor(1,000,000 * a * a / (l * r)).
    """
    known = counts.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    many = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    # the phrase is its two parts, so it needn't move beside them
    cut = cut.select("lang", "a", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, out in (("left", "l"), ("right", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(out)), ["lang", side])
    wide = "CAST({} AS DECIMAL(16,0))".format
    score = F.expr(f"(1000000BD * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})").alias("score")
    weakest = F.min(F.struct(score, F.size(F.split("left", " ")).alias("k"), "l", "r")).alias("best")
    scored = cut.groupBy("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a").agg(weakest)
    inner = many.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inside = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(inside, ["lang", "phrase"], "left").where(F.expr("longer IS NULL OR 100BD * longer < CAST(a AS DECIMAL(19,0)) * " + str(int(kept))))
    flat_ = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = flat_.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collocations(stored(phrase_counts(docs), "phrases"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), i AS (
  SELECT lang, p, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
), one AS (
  SELECT lang, x, lead(x) OVER (PARTITION BY p ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY p ORDER BY i) AS z FROM i
), f AS MATERIALIZED (
  SELECT lang, 1 AS k, x AS phrase, x, NULL AS y, NULL AS z, count(*) AS n FROM one GROUP BY lang, x
  UNION ALL
  SELECT lang, 2, x || ' ' || y, x, y, NULL, count(*) FROM one WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL
  SELECT lang, 3, x || ' ' || y || ' ' || z, x, y, z, count(*) FROM one WHERE z IS NOT NULL GROUP BY lang, x, y, z
), c AS MATERIALIZED (
  SELECT lang, k, phrase, x, y, z, n AS a FROM f WHERE k > 1 AND n >= 10
), parts AS (
  SELECT lang, phrase, a, 1 AS j, x AS left_part, y AS right_part FROM c WHERE k = 2
  UNION ALL
  SELECT lang, phrase, a, 1, x, y || ' ' || z FROM c WHERE k = 3
  UNION ALL
  SELECT lang, phrase, a, 2, x || ' ' || y, z FROM c WHERE k = 3
), lefts AS MATERIALIZED (
  SELECT t.*, u.n AS l FROM parts t JOIN f u ON u.lang = t.lang AND u.phrase = t.left_part
), cut AS (
  SELECT t.lang, t.phrase, t.a, t.j, t.l, v.n AS r,
         (1000000::HUGEINT * t.a::HUGEINT * t.a::HUGEINT) // (t.l::HUGEINT * v.n::HUGEINT) AS score
  FROM lefts t JOIN f v ON v.lang = t.lang AND v.phrase = t.right_part
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM cut) WHERE first = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, x || ' ' || y AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, y || ' ' || z, a FROM c WHERE k = 3
  ) GROUP BY lang, phrase
), free AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), ranked AS (
  SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, encode(free.phrase)) AS rank,
         free.phrase, a, l, r, total.n AS n, score
  FROM free JOIN total ON total.lang = free.lang
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
