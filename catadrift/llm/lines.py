"""Line deduplication through a sharded minimal perfect hash over the distinct line hashes.

1. Documents are dealt into blocks. A block hashes its lines and sends each distinct line once, with the number of
   documents and the largest id that hold it, to the shard of its hash: a line that a third of all documents hold
   reaches its shard once per block.
2. A shard adds these up and builds a minimal perfect hash over its distinct line hashes, which indexes three arrays:
   a compact fingerprint, the document count and the last holder.
3. The blocks probe the arrays with their distinct line hashes; only hits that must go return to the block, which
   drops those lines. Lines themselves are never shuffled or joined.

Edge cases: a null or empty text is one empty line; a null id counts as the smallest; rows that share an id are separate
documents for the count, and all of them keep their lines if the id is the largest holder. Other columns are carried
along whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import NO_ID, blocks, fresh, ids, packed, partitions, unpacked
from .texts import mix

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Slots per key of a level of the perfect hash, and most levels; keys left after them are kept in a sorted list.
SLOTS, LEVELS = 2, 32
BLOCKS_PER_PARTITION = 4


def line_key(line: str, min_chars: int) -> bytes | None:
    """The key's 128-bit hash; None for lines whose key is too short to count."""
    line = line.strip(WHITE)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace").lower()) if len(line) >= min_chars else None


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(high + turn ^ low) % np.uint64(size)).astype(np.int64)


def build_hash(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Minimal perfect hash of distinct 128-bit keys: bits per level, and the place (0 to n - 1) of each key."""
    levels, place, done, left = [], np.zeros(len(high), np.int64), 0, np.arange(len(high))
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(8, SLOTS * len(left))
        slot = _slots(high[left], low[left], level, size)
        alone = np.bincount(slot, minlength=size)[slot] == 1
        bits = np.zeros(size, bool)
        bits[slot[alone]] = True
        levels.append(bits)
        place[left[alone]] = done + (np.cumsum(bits) - 1)[slot[alone]]
        done, left = done + int(alone.sum()), left[~alone]
    place[left] = done + np.arange(len(left))
    return levels, place


def look_up(levels: list[np.ndarray], high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """The place of each key; -1 for keys beyond all levels. Keys outside the set get any place."""
    place, done, left = np.full(len(high), -1, np.int64), 0, np.arange(len(high))
    for level, bits in enumerate(levels):
        slot = _slots(high[left], low[left], level, len(bits))
        rank = np.cumsum(bits)
        hit = bits[slot]
        place[left[hit]] = done + rank[slot[hit]] - 1
        done, left = done + int(rank[-1]), left[~hit]
    return place


INDEX = "shard int, size long, level_bits array<binary>, fingerprints binary, counts binary, last binary, rest binary"
HASHED = "shard int, block int, keys binary, docs binary, last binary"


def _summaries(shards: int, text: str, key: str, block: str, min_chars: int):
    def run(table: pa.Table) -> pa.Table:
        count: dict[bytes, int] = {}
        last: dict[bytes, int] = {}
        for doc, body in zip(ids(table[key]).tolist(), table[text].to_pylist(), strict=True):
            for h in {line_key(x, min_chars) for x in (body or "").split("\n")} - {None}:
                count[h] = count.get(h, 0) + 1
                last[h] = max(doc, last.get(h, NO_ID))
        keys = np.frombuffer(b"".join(count), "<u8").reshape(-1, 2)
        rows = packed(
            (keys[:, 0] % np.uint64(shards)).astype(np.int64), keys=keys,
            docs=np.fromiter(count.values(), np.int64, len(count)), last=np.fromiter(last.values(), np.int64, len(last)),
        )
        rows["block"] = [table[block][0].as_py()] * len(rows["shard"])
        return pa.table({n: pa.array(rows[n], t) for n, t in _HASHED})

    return run


_HASHED = [("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("last", pa.binary())]


def _index(table: pa.Table) -> pa.Table:
    keys = unpacked(table["keys"], "<u8")[0].reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    docs = np.add.reduceat(unpacked(table["docs"], np.int64)[0][order], cut)
    last = np.maximum.reduceat(unpacked(table["last"], np.int64)[0][order], cut)
    keys = keys[cut]
    levels, place = build_hash(keys[:, 0], keys[:, 1])
    back = np.argsort(place)
    beyond = sum(int(x.sum()) for x in levels)
    prints = (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
        "size": pa.array([len(keys)], pa.int64()),
        "level_bits": pa.array([[np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
        "fingerprints": pa.array([prints[back].tobytes()], pa.binary()),
        "counts": pa.array([docs[back].tobytes()], pa.binary()),
        "last": pa.array([last[back].tobytes()], pa.binary()),
        "rest": pa.array([keys[back[beyond:]].tobytes()], pa.binary()),
    })


def _probe(min_docs: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        out = {"block": [], "keys": [], "last": []}
        if index.num_rows:
            row = index.to_pylist()[0]
            levels = [
                np.unpackbits(np.frombuffer(x[8:], np.uint8), count=int(np.frombuffer(x[:8], np.int64)[0])).astype(bool)
                for x in row["level_bits"]
            ]
            prints = np.frombuffer(row["fingerprints"], np.uint32)
            counts, last = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["last"], np.int64)
            rest = {bytes(x): row["size"] - len(row["rest"]) // 16 + i for i, x in enumerate(np.frombuffer(row["rest"], "V16"))}
            keys, lengths = unpacked(probes["keys"], "<u8")
            keys = keys.reshape(-1, 2)
            place = look_up(levels, keys[:, 0], keys[:, 1], row["size"])
            for i in np.flatnonzero(place < 0):
                place[i] = rest.get(keys[i].tobytes(), 0)
            gone = (prints[place] == (keys[:, 1] >> np.uint64(32)).astype(np.uint32)) & (counts[place] >= min_docs)
            edges = np.r_[0, np.cumsum(lengths // 2)]
            for block, a, b in zip(probes["block"].to_pylist(), edges[:-1], edges[1:], strict=True):
                if gone[a:b].any():
                    out["block"].append(block)
                    out["keys"].append(keys[a:b][gone[a:b]].tobytes())
                    out["last"].append(last[place[a:b][gone[a:b]]].tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "last": pa.array(out["last"], pa.binary())})

    return run


def _drop(text: str, key: str, block: str, total: str, dropped: str, min_chars: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        gone: dict[bytes, int] = {}
        for keys, last in zip(hits["keys"].to_pylist(), hits["last"].to_pylist(), strict=True):
            gone |= zip((keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(last, np.int64).tolist(), strict=True)
        kept, n_lines, n_dropped = [], [], []
        for doc, body in zip(ids(docs[key]).tolist(), docs[text].to_pylist(), strict=True):
            lines = (body or "").split("\n")
            stay = [x for x in lines if (h := line_key(x, min_chars)) is None or gone.get(h, doc) == doc]
            kept.append(body if len(stay) == len(lines) else "\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        docs = docs.set_column(docs.column_names.index(text), text, pa.array(kept, pa.string()))
        return docs.drop_columns([block]).append_column(total, pa.array(n_lines, pa.int64())).append_column(dropped, pa.array(n_dropped, pa.int64()))

    return run


def line_hashes(docs: DataFrame, block: str, shards: int, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per block and shard: the distinct line hashes, how many documents hold each, and the largest id that does."""
    return docs.groupBy(block).applyInArrow(_summaries(shards, text, key, block, min_chars), HASHED)


def line_index(hashed: DataFrame) -> DataFrame:
    """One row per shard: the perfect hash over its distinct line hashes and the arrays it indexes."""
    return hashed.groupBy("shard").applyInArrow(_index, INDEX)


def dedup_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    total: str = "n_lines", dropped: str = "n_dropped",
) -> DataFrame:
    """The documents without the lines held by `min_docs` documents or more, except in the largest id that holds them.

    Adds two columns: lines before dropping, and lines dropped.
    """
    parts = partitions(docs.sparkSession)
    block = fresh(docs, "line_block")
    dealt = blocks(docs, block, BLOCKS_PER_PARTITION * parts, key, text)
    hashed = line_hashes(dealt, block, parts, text, key, min_chars)
    hits = hashed.groupBy("shard").cogroup(line_index(hashed).groupBy("shard")).applyInArrow(
        _probe(min_docs), "block int, keys binary, last binary"
    ).withColumnRenamed("block", block)
    fields = [f for f in dealt.schema.fields if f.name != block]
    schema = T.StructType([*fields, T.StructField(total, T.LongType()), T.StructField(dropped, T.LongType())])
    return dealt.groupBy(block).cogroup(hits.groupBy(block)).applyInArrow(_drop(text, key, block, total, dropped, min_chars), schema)


def clean(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """The documents with their columns only, `length` brought up to date where lines were dropped."""
    total, dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    done = dedup_lines(docs, text, key, total=total, dropped=dropped)
    if length in docs.columns:
        done = done.withColumn(length, F.when(F.col(dropped) > 0, F.length(text).cast(dict(docs.dtypes)[length])).otherwise(F.col(length)))
    return done.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)
), bad AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, b.key IS NOT NULL AND l.doc_id <> b.last AS gone FROM lines l LEFT JOIN bad b USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
