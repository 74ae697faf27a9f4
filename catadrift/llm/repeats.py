"""Removal of repeated passages by suffix order: every byte that a `length`-byte string covers which also starts earlier.

The decision for a start is whether its longest previous factor - the longest prefix of the suffix at that start that
also starts at an earlier position - reaches `length`. In suffix order the nearest smaller position before and after a
suffix give that factor, so sorting suffixes and two scans for smaller positions settle every start at once. Suffixes
are compared over their first `length` bytes, which is all the decision needs.

A suffix order over the whole corpus would ship each byte `length` times. Instead every window of `length` bytes belongs
to its anchor, the leftmost smallest `gram`-byte hash inside it: equal windows have equal anchors at an equal place, so
only windows of equal anchors need a common suffix order, and these are few.

1. Documents are dealt into blocks. A run of windows with one anchor has a context, the bytes they cover together. A
   block keeps the first of equal contexts (the windows of later ones start earlier too) and sends anchor and context
   hashes, 24 bytes a run, to the shard of the anchor: no more than one record per block for a passage that a third of
   all documents hold.
2. The shard marks contexts that an earlier block has too, and those whose anchor stands in other contexts as well.
3. The blocks send the bytes of the latter; the shard sorts the suffixes of their windows and finds previous factors.
4. The blocks remove the bytes that marked windows cover.

Order is by id, then place. A null text is empty; a null id sorts first; rows that share an id are ordered by text, and
of equal rows any may count as the first. Other columns are carried along whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import blocks, fresh, ids, packed, partitions, unpacked
from .texts import Spans, byte_values, flat, mix, text_lots

LENGTH, GRAM = 100, 40
BLOCKS_PER_PARTITION = 2
ALONE, COVERED, OPEN = 0, 1, 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours, by the first of them."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def ordered(table: pa.Table, text: str, key: str) -> pa.Table:
    """By id; rows that share one, by text."""
    number = ids(table[key])
    if len(np.unique(number)) < len(number):
        body = np.array([x or "" for x in table[text].to_pylist()], dtype=object)
        order = sorted(range(len(number)), key=lambda i: (number[i], body[i]))
        return table.take(pa.array(order, pa.int64()))
    return table.take(pa.array(np.argsort(number, kind="stable")))


class Runs:
    """The windows of a block of texts, as runs that share an anchor, in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        parts = [self._lot(data, offsets, a, b, length, gram) for a, b in text_lots(offsets)]
        if not parts:
            parts = [(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)]
        self.first, self.last, self.doc, self.anchor, self.context = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _lot(data: np.ndarray, offsets: np.ndarray, a: int, b: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """The runs of texts a to b - 1."""
        base, offsets = offsets[a], offsets[a : b + 1] - offsets[a]
        sizes = np.diff(offsets)
        long = sizes >= length
        if not long.any():
            return *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2
        spans = Spans(data[base : base + offsets[-1]], byte_values())
        grams = spans.fixed(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
        valid = np.zeros(offsets[-1] + 1, np.int32)
        np.add.at(valid, offsets[:-1][long], 1)
        np.add.at(valid, offsets[1:][long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[: len(least)]))
        anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        first, last, anchor = start[cut], start[np.r_[cut[1:], len(start)] - 1], anchor[cut]
        shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
        context = mix(spans.hash(first, last + length) + mix(shape + np.uint64(1)))
        return first + base, last + base, a + np.searchsorted(offsets, first, side="right") - 1, grams[anchor], context

    def firsts(self) -> np.ndarray:
        """Runs whose anchor and context no earlier run of the block has."""
        order = np.lexsort((self.context, self.anchor))
        a, c = self.anchor[order], self.context[order]
        lead = np.ones(len(order), bool)
        lead[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        out = np.zeros(len(order), bool)
        out[order[lead]] = True
        return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each one; -1 for none."""
    found = np.arange(-1, len(x) - 1)
    open_ = np.arange(len(x))
    while len(open_):
        open_ = open_[found[open_] >= 0]
        open_ = open_[x[found[open_]] > x[open_]]
        found[open_] = found[found[open_]]
    return found


def repeated_starts(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each start reaches `length`; position orders the starts."""
    n = len(data)
    rank = np.zeros(n + length, np.uint64)
    rank[:n] = data
    for half in (1, 2, 4):  # eight bytes, as a number
        shifted = np.r_[rank[half:], np.zeros(half, np.uint64)]
        rank = rank << np.uint64(8 * half) | shifted
    rank, span = np.unique(rank, return_inverse=True)[1].astype(np.uint64), 8
    while 2 * span <= length:
        pair = rank << np.uint64(32) | np.r_[rank[span:], np.zeros(span, np.uint64)]
        rank, span = np.unique(pair, return_inverse=True)[1].astype(np.uint64), 2 * span
    suffix = rank[starts] << np.uint64(32) | rank[starts + length - span]
    order = np.argsort(suffix, kind="stable")
    suffix, position = suffix[order], position[order]
    before = previous_smaller(position)
    after = len(position) - 1 - previous_smaller(position[::-1])[::-1]
    hit = (before >= 0) & (suffix[before] == suffix)
    hit |= (after < len(position)) & (suffix[np.minimum(after, len(position) - 1)] == suffix)
    out = np.zeros(len(starts), bool)
    out[order] = hit
    return out


ANCHORS = "shard int, block int, anchors binary, contexts binary, ids binary"
MARKS = "shard int, block int, marks binary, docs binary, starts binary, counts binary"
CONTEXTS = "shard int, block int, ids binary, docs binary, starts binary, counts binary, bytes binary"


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names = [x.split(" ") for x in schema.split(", ")]
    n = max(len(x) for x in columns.values())
    return pa.table({name: pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in names})


class Blocks:
    """What happens to a block, in its three passes."""

    def __init__(self, text: str, key: str, block: str, shards: int, length: int, gram: int):
        self.text, self.key, self.block, self.shards, self.length, self.gram = text, key, block, shards, length, gram

    def runs(self, docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Runs, np.ndarray, np.ndarray]:
        docs = ordered(docs, self.text, self.key)
        data, offsets = flat(docs[self.text])
        runs = Runs(data, offsets, self.length, self.gram)
        first = np.flatnonzero(runs.firsts())
        return docs, data, offsets, runs, first, (runs.anchor[first] % np.uint64(self.shards)).astype(np.int64)

    def send_anchors(self, docs: pa.Table) -> pa.Table:
        name = docs[self.block][0].as_py()
        docs, _, _, runs, first, shard = self.runs(docs)
        rows = packed(shard, anchors=runs.anchor[first], contexts=runs.context[first], ids=ids(docs[self.key])[runs.doc[first]])
        return _table(ANCHORS, block=[name] * len(rows["shard"]), **rows)

    def marks(self, marks: pa.Table, shard: np.ndarray) -> np.ndarray:
        """The marks of the block's first runs, from the shards' answers."""
        out = np.zeros(len(shard), np.uint8)
        order = np.argsort(shard, kind="stable")
        begin = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, got in zip(marks["shard"].to_pylist(), marks["marks"].to_pylist(), strict=True):
            if got is not None:
                out[order[begin[s] : begin[s + 1]]] = np.frombuffer(got, np.uint8)
        return out

    def send_contexts(self, docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows or not marks.num_rows:
            return _table(CONTEXTS, shard=[])
        name = docs[self.block][0].as_py()
        docs, data, offsets, runs, first, shard = self.runs(docs)
        wanted = self.marks(marks, shard) == OPEN
        at, shard = first[wanted], shard[wanted]
        begin, end = runs.first[at], runs.last[at] + self.length
        order = np.argsort(shard, kind="stable")
        rows = packed(
            shard, ids=ids(docs[self.key])[runs.doc[at]], docs=runs.doc[at].astype(np.uint32),
            starts=(begin - offsets[runs.doc[at]]).astype(np.uint32), counts=(runs.last[at] - begin + 1).astype(np.uint32),
        )
        bodies: dict[int, list] = {}
        for i in order:
            bodies.setdefault(int(shard[i]), []).append(data[begin[i] : end[i]].tobytes())
        rows["bytes"] = [b"".join(bodies[s]) for s in rows["shard"]]
        return _table(CONTEXTS, block=[name] * len(rows["shard"]), **rows)

    def remove(self, size: str, removed: str, spans: str):
        def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
            docs, data, offsets, runs, first, shard = self.runs(docs)
            covered = np.ones(len(runs.first), bool)
            covered[first] = self.marks(marks, shard) == COVERED
            begin, count = [runs.first[covered]], [(runs.last - runs.first + 1)[covered]]
            for row in marks.select(["docs", "starts", "counts"]).to_pylist():
                if row["docs"] is not None:
                    begin.append(offsets[np.frombuffer(row["docs"], np.uint32)] + np.frombuffer(row["starts"], np.uint32))
                    count.append(np.frombuffer(row["counts"], np.uint32).astype(np.int64))
            begin, count = np.concatenate(begin), np.concatenate(count)
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + count + self.length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept, found = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False])).reshape(-1, 2)
                found.append([{"start": int(x), "end": int(y)} for x, y in edge])
                kept.append(data[a:b][~gone[a:b]].tobytes() if len(edge) else data[a:b].tobytes())
            docs = docs.set_column(docs.column_names.index(self.text), self.text, pa.array(kept, pa.binary())).drop_columns([self.block])
            total = np.diff(offsets)
            docs = docs.append_column(size, pa.array(total)).append_column(removed, pa.array(total - np.array([len(x) for x in kept], dtype=np.int64)))
            return docs.append_column(spans, pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

        return run


def mark(table: pa.Table) -> pa.Table:
    """For a shard's anchors: which contexts an earlier block has too, and which anchors stand in several contexts."""
    anchor, lengths = unpacked(table["anchors"], np.uint64)
    context, number = unpacked(table["contexts"], np.uint64)[0], unpacked(table["ids"], np.int64)[0]
    order = np.lexsort((number, context, anchor))
    a, c = anchor[order], context[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]]
    new_context = new_anchor | np.r_[True, c[1:] != c[:-1]]
    group = np.cumsum(new_anchor) - 1
    several = np.bincount(group, weights=new_context)[group] > 1
    marks = np.zeros(len(anchor), np.uint8)
    marks[order] = np.where(~new_context, COVERED, np.where(several, OPEN, ALONE))
    edges = np.r_[0, np.cumsum(lengths)]
    told = [(i, x, y) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if marks[x:y].any()]
    shard, block = table["shard"].to_pylist(), table["block"].to_pylist()
    return _table(
        MARKS, shard=[shard[i] for i, _, _ in told], block=[block[i] for i, _, _ in told], marks=[marks[x:y].tobytes() for _, x, y in told]
    )


def settle(length: int):
    """For a shard's contexts: the windows that also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        number, lengths = unpacked(table["ids"], np.int64)
        doc, start, count = (unpacked(table[x], np.uint32)[0].astype(np.int64) for x in ("docs", "starts", "counts"))
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        size = count + length - 1
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        position = np.empty(len(owner), np.int64)
        position[np.lexsort((start[owner] + shift, doc[owner], number[owner]))] = np.arange(len(owner))
        hit = np.flatnonzero(repeated_starts(data, begin[owner] + shift, position, length))
        lead = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else np.zeros(0, bool)
        cut = np.flatnonzero(lead)
        many = np.diff(np.r_[cut, len(hit)])
        hit = hit[cut]
        row = np.repeat(np.arange(len(lengths)), lengths)[owner[hit]]
        out = packed(
            row, docs=doc[owner[hit]].astype(np.uint32), starts=(start[owner[hit]] + shift[hit]).astype(np.uint32), counts=many.astype(np.uint32)
        )
        block = table["block"].to_pylist()
        out["block"] = [block[i] for i in out["shard"]]
        out["shard"] = [0] * len(out["block"])
        return _table(MARKS, **out)

    return run


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
    size: str = "n_bytes", removed: str = "n_removed", spans: str = "spans",
) -> DataFrame:
    """The documents with `text` as binary, without repeated passages.

    Adds the bytes before removal, the bytes removed, and the removed spans (start, end) in bytes.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be at least 8 and at most length")
    parts = partitions(docs.sparkSession)
    block = fresh(docs, "repeat_block")
    dealt = blocks(docs, block, BLOCKS_PER_PARTITION * parts, key)
    work = Blocks(text, key, block, parts, length, gram)
    anchors = dealt.groupBy(block).applyInArrow(lambda t: work.send_anchors(t), ANCHORS)
    marks = anchors.groupBy("shard").applyInArrow(mark, MARKS).withColumnRenamed("block", block)
    by_block = dealt.groupBy(block)
    contexts = by_block.cogroup(marks.groupBy(block)).applyInArrow(lambda t, m: work.send_contexts(t, m), CONTEXTS)
    more = contexts.groupBy("shard").applyInArrow(settle(length), MARKS).withColumnRenamed("block", block)
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in dealt.schema.fields if f.name != block]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField(size, T.LongType()), T.StructField(removed, T.LongType()), T.StructField(spans, span)])
    return by_block.cogroup(marks.unionByName(more).groupBy(block)).applyInArrow(work.remove(size, removed, spans), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
