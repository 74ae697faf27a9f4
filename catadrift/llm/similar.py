"""Exact Jaccard join and connected components over word shingles, with PartEnum signatures.

Sets whose Jaccard similarity is 0.8 or more differ in few elements: at most (a + b) / 9 for sizes a and b. Sizes are cut
into bands whose ends are 0.8 apart, so that similar sets lie in one band or in neighbouring ones; a set takes part in its
own band and the next. A band with largest size m allows k = 2m / 9 differences. It divides the domain of shingles into
first-level parts of three cells each; with more than k / 2 parts, k differences leave a part of which one cell at most
is touched, so similar sets agree on two of its cells. All pairs of cells of all parts are the signatures. (For k below 4
there is one part of k + 2 cells.) Signatures over empty cells would be shared by far too many sets. A set in which
enough parts have no empty signature doesn't need them; any other takes a further division of the domain too, and only a
set that needs them in all divisions keeps them. As both sets of a pair use the first division, and the second if both
are of the latter kind, and so on, no pair is lost.

1. Equal sets are one class, a node of the graph. Signatures go to the shard of their hash; a shard finds those that
   several classes share and pairs each of these classes with the smallest one.
2. Pairs whose sketches differ in more bits than similar sets may differ in elements are ruled out; the others are
   verified on the whole sets, and components found.
3. Signatures shared by classes of several components may hide further links. The sketches of such groups' classes go to
   the group's shard, where classes of different components are compared by them. Only the sets of classes that have such
   a partner follow; what is similar joins their components, so only links that join two components leave, never more
   than there are members. A group of many members is dealt into blocks, and each pair of blocks is a task of its own. No
   pair is left out that could link two components.

Edge cases: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle are one; rows
that share an id are separate documents, each in the component of its set; a document without an id is in the component
of documents with an equal set, if there are any, else in none. Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bit_field, checkpoint, fresh, may_hold, partitions, stored, unpacked
from .texts import flat, mix, shingles, text_lots

WORDS = 5
#: Divisions of the domain that are tried before signatures over empty cells are used.
DIVISIONS = 8
#: More first-level parts than needed, as a share, so that few sets need another division.
SPARE = 0.12
FLUSH = 500_000


@lru_cache(1)
def bands() -> np.ndarray:
    """The smallest size of each band."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 5 // 4 + 1)
    return np.array(low)


def geometry(band: int) -> tuple[int, int, int]:
    """Differences allowed, parts, cells per part."""
    k = 2 * int(bands()[band + 1] - 1) // 9
    if k < 4:
        return k, 1, k + 2
    parts = k // 2 + 1
    return k, parts + int(SPARE * parts), 3


def set_hash(owner: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, owner, mix(elements ^ np.uint64(0x5851F42D4C957F2D)))
    return mix(out)


def cells(owner: np.ndarray, elements: np.ndarray, n: int, band: int, division: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and emptiness of each set's cells: arrays of (set, part, cell)."""
    _, parts, width = geometry(band)
    seed = mix(np.array([band * 64 + division + 1], np.uint64))[0]
    place = owner * (parts * width) + (mix(elements ^ seed) % np.uint64(parts * width)).astype(np.int64)
    total = np.zeros(n * parts * width, np.uint64)
    np.add.at(total, place, mix(elements + seed))
    empty = np.ones(len(total), bool)
    empty[place] = False
    return mix(total).reshape(n, parts, width), empty.reshape(n, parts, width)


def signatures(owner: np.ndarray, elements: np.ndarray, n: int, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sets, signatures) of n sets in a band."""
    k, parts, width = geometry(band)
    tag = np.uint64(band) << np.uint64(32)
    if k == 0:  # similar sets are equal
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, mix(elements))
        yield np.arange(n), mix(total ^ tag)
        return
    left = np.arange(n)
    for division in range(DIVISIONS):
        value, empty = cells(owner, elements, len(left), band, division)
        if width == 3:
            strong = parts - (empty.sum(axis=2) >= 2).sum(axis=1) > k // 2
        else:
            strong = empty[:, 0, :].sum(axis=1) <= 1
        last = division == DIVISIONS - 1
        for a in range(width):
            for b in range(a + 1, width):
                what = mix(np.array([(division * 64 + a) * 64 + b], np.uint64))[0] ^ tag
                sign = mix(mix(value[:, :, a] * np.uint64(3) + value[:, :, b]) ^ (what + np.arange(parts, dtype=np.uint64)[None, :]))
                use = ~(empty[:, :, a] & empty[:, :, b])
                if last:
                    use |= ~strong[:, None]
                row, col = np.nonzero(use)
                yield left[row], sign[row, col]
        again = ~strong
        if last or not again.any():
            return
        keep = again[owner]
        renumber = np.cumsum(again) - 1
        owner, elements, left = renumber[owner[keep]], elements[keep], left[again]


def text_sets(batch: pa.RecordBatch, text: str, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Lot by lot: first row, size of each row's set, owner and elements."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    for a, b in text_lots(offsets):
        base = offsets[a]
        owner, elements = shingles(data[base : offsets[b]], offsets[a : b + 1] - base, words)
        yield a, np.bincount(owner, minlength=b - a), owner, elements


def describe(words: int):
    """Per document: size and class of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, size, owner, elements in text_sets(batch, "text", words):
                name = set_hash(owner, elements, len(size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(size)), pa.array(size.astype(np.int64)), pa.array(name)], names=["id", "size", "class"])

    return run


def sign(words: int, shards: int):
    """The signatures of a partition's classes, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names, sizes, counts = [], [], []
        held = 0
        for batch in batches:
            for _, size, owner, elements in text_sets(batch, "text", words):
                name = set_hash(owner, elements, len(size))
                mine = np.zeros(len(size), bool)
                for i, h in enumerate(name.tolist()):
                    if size[i] and h not in seen:
                        seen.add(h)
                        mine[i] = True
                band = np.searchsorted(bands(), size, side="right") - 1
                for b in np.unique(band[mine]):
                    which = np.flatnonzero(mine & (band == b))
                    number = np.full(len(size), -1)
                    number[which] = np.arange(len(which))
                    inside = number[owner] >= 0
                    for t in (int(b), int(b) + 1):
                        for who, code in signatures(number[owner[inside]], elements[inside], len(which), t):
                            names.append(name[which[who]])
                            sizes.append(size[which[who]].astype(np.uint32))
                            counts.append(code)
                            held += len(code)
                if held >= FLUSH:
                    yield _signed(names, sizes, counts, shards)
                    names, sizes, counts, held = [], [], [], 0
        if held:
            yield _signed(names, sizes, counts, shards)

    return run


SIGNED = "shard int, classes binary, sizes binary, counts binary, codes binary"
SHARED = "a long, b long, g long, band int, lead long, chunk int, members array<long>"
#: Members of a group in one row.
MEMBERS = 10_000


def planes(values: np.ndarray) -> bytes:
    """32-bit values as their lowest bytes, then their second ones and so on; small values then compress to one byte or less."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _signed(names: list, sizes: list, codes: list, shards: int) -> pa.RecordBatch:
    """One row per shard: classes by size, the steps of their sizes, how many signatures of each, and the signatures' further 32 bits.

    The more shards, the fewer signatures share what is said of their class, so that is kept short.
    """
    name, size, code = np.concatenate(names), np.concatenate(sizes), np.concatenate(codes)
    shard = (code % np.uint64(shards)).astype(np.int64)
    code = (code // np.uint64(shards)).astype(np.uint32)
    order = np.lexsort((name, size, shard))
    name, size, code, shard = name[order], size[order], code[order], shard[order]
    head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (shard[1:] != shard[:-1])])
    count = np.diff(np.r_[head, len(name)])
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    edge = np.r_[cut, len(shard)]
    edge_head = np.searchsorted(head, edge)
    rows = [
        (int(shard[a]), name[head[x:y]].tobytes(), planes(np.diff(size[head[x:y]].astype(np.int64), prepend=0)), planes(count[x:y]), code[a:b].tobytes())
        for a, b, x, y in zip(edge[:-1], edge[1:], edge_head[:-1], edge_head[1:], strict=True)
    ]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["shard", "classes", "sizes", "counts", "codes"]
    )


def share(table: pa.Table) -> pa.Table:
    """Pairs of each shared signature's smallest class with the others and their larger band, and groups of three and more, in rows of bounded size."""
    name, code = unpacked(table["classes"], np.int64)[0], unpacked(table["codes"], np.uint32)[0]
    size = np.concatenate([np.cumsum(from_planes(x)) for x in table["sizes"].to_pylist()])
    count = np.concatenate([from_planes(x) for x in table["counts"].to_pylist()])
    who = np.repeat(np.arange(len(name)), count)
    order = np.lexsort((name[who], code))
    code, who = code[order], who[order]
    fresh_ = np.r_[True, (code[1:] != code[:-1]) | (name[who[1:]] != name[who[:-1]])] if len(code) else np.zeros(0, bool)
    code, who = code[fresh_], who[fresh_]
    cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    many = np.diff(np.r_[cut, len(code)])
    lead = np.repeat(cut, many)
    follower = np.arange(len(code)) != lead
    a, b = who[lead[follower]], who[follower]
    fit = (5 * size[a] >= 4 * size[b]) & (5 * size[b] >= 4 * size[a])
    band = np.searchsorted(bands(), size, side="right") - 1
    pairs = np.c_[name[a[fit]], name[b[fit]], np.maximum(band[a[fit]], band[b[fit]])]
    pairs = np.unique(pairs, axis=0) if fit.any() else np.zeros((0, 3), np.int64)
    groups: dict[bytes, tuple[int, np.ndarray]] = {}
    for x, n in zip(cut[many >= 3], many[many >= 3], strict=True):
        inside = who[x : x + n]
        present = np.unique(band[inside])
        for t in present:
            if t + 1 in present and t - 1 not in present:
                continue  # a part of the next one
            take = inside[(band[inside] == t) | (band[inside] == t - 1)]
            if len(take) >= 3:
                members = name[take]
                groups.setdefault(members.tobytes() + bytes([int(t)]), (int(t), members))
    rows = [
        (int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True), t, int(members.min()), at // MEMBERS, members[at : at + MEMBERS].tolist())
        for key, (t, members) in groups.items()
        for at in range(0, len(members), MEMBERS)
    ]
    none = [None] * len(pairs)
    return pa.table({
        "a": pa.array([*pairs[:, 0].tolist(), *[None] * len(rows)], pa.int64()),
        "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(rows)], pa.int64()),
        "g": pa.array([*none, *[r[0] for r in rows]], pa.int64()),
        "band": pa.array([*pairs[:, 2].tolist(), *[r[1] for r in rows]], pa.int32()),
        "lead": pa.array([*none, *[r[2] for r in rows]], pa.int64()),
        "chunk": pa.array([*none, *[r[3] for r in rows]], pa.int32()),
        "members": pa.array([*none, *[r[4] for r in rows]], pa.list_(pa.int64())),
    })


def shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, size, owner, elements in text_sets(batch, "text", words):
                edge = np.r_[0, np.cumsum(size)]
                name = batch.column(0).slice(a, len(size)).to_numpy()
                right = np.flatnonzero(set_hash(owner, elements, len(size)).view(np.int64) == name)  # else another row with the id
                body = [elements[edge[i] : edge[i + 1]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([pa.array(name[right]), pa.array(body, pa.binary())], names=["class", "elements"])

    return run


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sets are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sketches differ in no more bits than similar sets may differ in elements."""
    for batch in batches:
        keep = []
        for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            keep.append(int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) <= n // 9)
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def filter_pairs(pairs: DataFrame, cell: DataFrame) -> DataFrame:
    """The pairs that their sketches in the larger set's band don't rule out."""
    x, y = (cell.select(*[F.col(n).alias(f"{c}_{n}") for n in ("class", "band", "size", "sketch")]) for c in ("a", "b"))
    both = pairs.join(x, (F.col("a") == F.col("a_class")) & (F.col("band") == F.col("a_band")))
    both = both.join(y, (F.col("b") == F.col("b_class")) & (F.col("band") == F.col("b_band")))
    return both.select("a", "b", (F.col("a_size") + F.col("b_size")).alias("n"), "a_sketch", "b_sketch").mapInArrow(plausible, "a long, b long")


def whole_sets(asked: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class and elements of the asked classes; sets are read off one document of each class."""
    one = checkpoint(asked.join(classes, "class").select("class", F.col("one").alias("id")))
    # the field spares most texts that no pair needs the shuffle; the join decides
    texts = docs.where(may_hold(bit_field(one, "id"), "id")).join(one, "id")
    # another row with the id may have an equal set
    return texts.select("class", "text").mapInArrow(shingle_sets(words), "class long, elements binary")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), docs, classes, words)
    left, right = (sets.select(F.col("class").alias(c), F.col("elements").alias(f"{c}_elements")) for c in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_elements", "b_elements").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component.

    Nodes with one label are a tree. Each round, every tree takes the smallest label next to it, and the label that one
    takes; trees at least halve, so the rounds grow with the logarithm of the largest component.
    """
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("node") == F.col("x")).select("root", F.least("root", "near").alias("low"))
        hook = stored(low.groupBy("root").agg(F.min("low").alias("new")), "hooks")
        if hook.where("new <> root").isEmpty():
            return labels
        far = hook.select(F.col("root").alias("new"), F.col("new").alias("far"))
        jump = hook.join(far, "new", "left").select("root", F.coalesce("far", "new").alias("to"))
        labels = stored(labels.join(jump, "root").select("node", F.col("to").alias("root")), "labels")


#: Bits of a sketch for each element of a band's largest set.
SKETCH_BITS = 4


def sketch_rows(owner: np.ndarray, elements: np.ndarray, n: int, band: int) -> np.ndarray:
    """A row of bits for each set: whether an odd number of its elements falls on the bit.

    An element that one of two sets lacks turns one bit, so the sets differ in at least as many elements as bits.
    """
    width = SKETCH_BITS * int(bands()[band + 1] - 1)
    seed = mix(np.array([band * 64], np.uint64))[0]
    place = owner * width + (mix(elements ^ seed) % np.uint64(width)).astype(np.int64)
    odd = np.bincount(place, minlength=n * width).reshape(n, width) & 1
    return np.packbits(odd.astype(bool), axis=1)


SKETCHED = "class long, band int, own int, size long, sketch binary"


def sketches(words: int):
    """Per class and band: the set's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, size, owner, elements in text_sets(batch, "text", words):
                name = set_hash(owner, elements, len(size)).view(np.int64)
                band = np.searchsorted(bands(), size, side="right") - 1
                for i, h in enumerate(name.tolist()):
                    if h in seen:
                        band[i] = -1
                    seen.add(h)
                for b in np.unique(band[band >= 0]):
                    which = np.flatnonzero(band == b)
                    number = np.full(len(size), -1)
                    number[which] = np.arange(len(which))
                    inside = number[owner] >= 0
                    for t in (int(b), int(b) + 1):
                        body = sketch_rows(number[owner[inside]], elements[inside], len(which), t)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(name[which]), pa.array(np.full(len(which), t, np.int32)), pa.array(np.full(len(which), b, np.int32)),
                                pa.array(size[which].astype(np.int64)), pa.array([x.tobytes() for x in body], pa.binary()),
                            ],
                            names=["class", "band", "own", "size", "sketch"],
                        )

    return run


#: Members of a group that are compared at once, members of a block of a large group, bits of sketches made and bytes of them compared at once.
ROWS, BLOCK, BITS, BYTES = 32, 2_000, 1 << 21, 1 << 22


def near(size: np.ndarray, sketch: np.ndarray, at: int, fit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In lots, the pairs of a strip of members (`fit`: from `at` on, with all after that) that sizes and sketches don't rule out."""
    x, y = np.nonzero(fit)
    x, y = x + at, y + at + 1
    alike = (5 * size[y] >= 4 * size[x]) & (4 * size[y] <= 5 * size[x])
    x, y = x[alike], y[alike]
    step = max(1, BYTES // sketch.shape[1])
    for a in range(0, len(x), step):
        p, q = x[a : a + step], y[a : a + step]
        keep = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1) <= (size[p] + size[q]) // 9
        yield p[keep], q[keep]


def group_edges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal keys are together (last key first), and where each run begins and the last one ends."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.r_[np.flatnonzero(new), len(order)]


OPEN = "shard long, first int, second int, g long, band int, class long, root long, own int"


def open_members(rows: pa.Table, cell: pa.Table) -> pa.Table:
    """Members of groups that have a partner of another component in their group that sketches don't rule out."""
    rows = rows.select([c.split()[0] for c in OPEN.split(", ")])
    place = {x: i for i, x in enumerate(zip(cell["node"].to_pylist(), cell["level"].to_pylist(), strict=True))}
    at = np.array([place.get(x, -1) for x in zip(rows["class"].to_pylist(), rows["band"].to_pylist(), strict=True)], dtype=np.int64)
    rows, at = rows.filter(pa.array(at >= 0)), at[at >= 0]
    if rows.num_rows == 0:
        return rows
    sketch, size = cell["sketch"].to_pylist(), cell["size"].to_numpy()[at]
    first, second, group, band, component, block = (rows[c].to_numpy() for c in ("first", "second", "g", "band", "root", "own"))
    order, edge = group_edges(group, second, first, band)
    found, known = np.zeros(len(order), bool), -1
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        mine = order[a:b]
        if band[mine[0]] != known:
            known = band[mine[0]]
            which = np.unique(at[band == known])
            bits = np.frombuffer(b"".join(sketch[i] for i in which), np.uint8).reshape(len(which), -1)
        root, part, apart = component[mine], block[mine], first[mine[0]] != second[mine[0]]
        held, lengths, hit = bits[np.searchsorted(which, at[mine])], size[mine], np.zeros(len(mine), bool)
        for x in range(0, len(mine), ROWS):
            i, j = np.arange(x, min(x + ROWS, len(mine)))[:, None], np.arange(x + 1, len(mine))[None, :]
            fit = (j > i) & (root[i] != root[j]) & ~(hit[i] & hit[j])  # of two found ones nothing is left to find
            if apart:
                fit &= part[i] != part[j]
            for p, q in near(lengths, held, x, fit):
                hit[p] = hit[q] = True
        found[mine] = hit
    return rows.filter(pa.array(found))


class Group:
    """The classes that a task has got: sets, sketches, and components as they are joined."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.place = {c: i for i, c in enumerate(names)}
        self.sets = [sets[i] for i in self.place.values()]
        self.names = np.array(list(self.place), dtype=np.int64)
        self.place = {c: i for i, c in enumerate(self.place)}
        self.size = np.array([len(x) for x in self.sets], dtype=np.int64)
        self.parent: dict[int, int] = {}
        self.tried: set[tuple[int, int]] = set()

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def sketches(self, which: np.ndarray, band: int) -> np.ndarray:
        step = max(1, BITS // (SKETCH_BITS * int(bands()[band + 1] - 1)))
        out = []
        for at in range(0, len(which), step):
            part = which[at : at + step]
            owner = np.repeat(np.arange(len(part)), self.size[part])
            out.append(sketch_rows(owner, np.concatenate([self.sets[i] for i in part]), len(part), band))
        return np.concatenate(out)

    def similar(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * both >= 80 * (len(self.sets[i]) + len(self.sets[j]) - both)

    def links(self, member: np.ndarray, component: np.ndarray, block: np.ndarray, apart: bool, sketch: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between members of one group that join two components; `apart`: of different blocks only."""
        size = self.size[member]
        for at in range(0, len(member), ROWS):
            now = np.array([self.root(x) for x in component.tolist()])
            if (now == now[0]).all():
                return
            i, j = np.arange(at, min(at + ROWS, len(member)))[:, None], np.arange(at + 1, len(member))[None, :]
            fit = (j > i) & (now[i] != now[j])
            if apart:
                fit &= block[i] != block[j]
            for p, q in near(size, sketch, at, fit):
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    r, s = self.root(int(component[u])), self.root(int(component[v]))
                    pair = min(int(member[u]), int(member[v])), max(int(member[u]), int(member[v]))
                    if r != s and pair not in self.tried:
                        if self.similar(*pair):
                            self.parent[max(r, s)] = min(r, s)
                            yield pair
                        else:
                            self.tried.add(pair)


def group_links(rows: pa.Table, sets: pa.Table) -> pa.Table:
    """Links between classes of a group and of different components, enough of them to join what is similar."""
    task = Group(sets["node"].to_pylist(), [np.frombuffer(x, np.uint64) for x in sets["elements"].to_pylist()])
    rows = rows.filter(pa.array([c in task.place for c in rows["class"].to_pylist()], pa.bool_()))
    found = []
    if rows.num_rows:
        first, second, group, band, component, block = (rows[c].to_numpy() for c in ("first", "second", "g", "band", "root", "own"))
        member = np.array([task.place[c] for c in rows["class"].to_pylist()], dtype=np.int64)
        order, edge = group_edges(group, second, first, band)
        known = -1
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = order[a:b]
            if band[at[0]] != known:
                known = int(band[at[0]])
                which = np.unique(member[band == known])
                sketch = task.sketches(which, known)
            mine = sketch[np.searchsorted(which, member[at])]
            found += task.links(member[at], component[at], block[at], bool(first[at[0]] != second[at[0]]), mine)
    return pa.table({"a": pa.array([int(min(task.names[i], task.names[j])) for i, j in found], pa.int64()), "b": pa.array([int(max(task.names[i], task.names[j])) for i, j in found], pa.int64())})


def sketched(plain: DataFrame, words: int) -> DataFrame:
    """The sketches of all classes in their band and the next."""
    return plain.mapInArrow(sketches(words), SKETCHED).dropDuplicates(["class", "band"])


def hidden_links(shared: DataFrame, labels: DataFrame, plain: DataFrame, classes: DataFrame, words: int, cell: DataFrame | None = None) -> DataFrame | None:
    """Links between components whose classes share signatures, enough of them to join what is similar; None if no group can hold one."""
    groups = shared.where("g IS NOT NULL").dropDuplicates(["g", "chunk"]).select("g", "band", "lead", F.explode("members").alias("class"))
    members = groups.join(labels.withColumnRenamed("node", "class"), "class", "left")
    members = checkpoint(members.select("g", "band", "lead", "class", F.coalesce("root", "class").alias("root")))
    open_ = members.groupBy("g", "lead").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    # groups with one smallest class are much the same classes, so they meet in the same tasks and their sets move once
    most = open_.groupBy("lead").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("blocks"))
    mine = members.join(open_.select("g"), "g").join(most, "lead")
    mine = mine.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = mine.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    shard = F.pmod(F.xxhash64("lead", "first", "second"), F.lit(4 * partitions(plain.sparkSession))).alias("shard")
    mine = checkpoint(mine.select(shard, "first", "second", "g", "band", "class", "root", "own"))
    if mine.isEmpty():
        return None
    # sketches go first: they are a sixteenth of the sets, and most members have no partner that theirs leaves possible
    cell = sketched(plain, words) if cell is None else cell
    wanted = mine.select(F.col("shard").alias("place"), F.col("class").alias("node"), F.col("band").alias("level")).distinct()
    some = cell.where(may_hold(bit_field(mine, "class"), "class")).select("class", "band", "size", "sketch")
    held = wanted.join(some, (F.col("node") == F.col("class")) & (F.col("level") == F.col("band"))).select("place", "node", "level", "size", "sketch")
    mine = checkpoint(mine.groupBy("shard").cogroup(held.groupBy("place")).applyInArrow(open_members, OPEN))
    if mine.isEmpty():
        return None
    sets = whole_sets(mine.select("class").distinct(), plain, classes, words).dropDuplicates(["class"])
    places = mine.select(F.col("shard").alias("place"), F.col("class").alias("node")).distinct()
    held = places.join(sets.withColumnRenamed("class", "node"), "node")
    return mine.groupBy("shard").cogroup(held.groupBy("place")).applyInArrow(group_links, "a long, b long").distinct()


def similar_classes(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, size, class) of each document, and (node, root) of the classes that have links."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    info = checkpoint(plain.mapInArrow(describe(words), "id long, size long, class long"))
    # one document per class, to read its set from
    classes = info.where("size > 0 AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("one"))
    signed = plain.mapInArrow(sign(words, partitions(docs.sparkSession)), SIGNED)
    shared = checkpoint(signed.groupBy("shard").applyInArrow(share, SHARED))
    cell = checkpoint(sketched(plain, words))
    first = shared.where("a IS NOT NULL").select("a", "b", "band").distinct()
    links = checkpoint(verify(checkpoint(filter_pairs(first, cell)), plain, classes, words))
    labels = components(links)
    more = hidden_links(shared, labels, plain, classes, words, cell)
    if more is not None:
        labels = components(checkpoint(links.unionByName(more)))
    return info, labels


def components_of(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id of the component) of each document."""
    info, labels = similar_classes(docs, words, key, text)
    named = info.join(labels.withColumnRenamed("node", "class"), "class", "left").select("id", "size", F.when(F.col("size") > 0, F.coalesce("root", "class")).alias("root"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(least, "root", "left").select(F.col("id"), F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def drop_similar(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; of rows that share an id, all or none stay."""
    found = components_of(docs, words, key, text)
    gone = found.where(F.col("id").isNotNull() & (F.col("component_id") != F.col("id"))).select(F.col("id").alias(fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[key] == gone[gone.columns[0]], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), reach AS (
  SELECT a AS node, a AS other FROM link
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.least, d.doc_id), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) c ON c.node = d.doc_id
"""
