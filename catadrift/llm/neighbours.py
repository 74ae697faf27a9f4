"""Approximate nearest neighbours by inner product along several shifted Hilbert curves.

Each curve projects the vectors at random to a few dimensions, shifts them by a random offset, and orders them by their
Hilbert key. The orders are cut into slices of equal size, with bounds taken from a bounded sample; equal keys are told
apart by a hash of id and curve, so that many equal vectors spread over slices, and differently on each curve. A query goes to its slice and those around it;
each slice ranks its vectors against its queries with one matrix product; the best of all curves are merged, scored in
double precision on the original vectors.

Longer vectors must not win the order by their length only: vectors get a further component that makes all lengths equal,
queries get 0 there, after which nearness on the sphere is the inner product.

The share of a curve that a query sees is a parameter. `SHARE` and `CURVES` are set for vectors without much structure
(on nearly isotropic 64-dimensional vectors, recall about 0.97); vectors that gather in clusters need far less.

Edge cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no
part, neither do null ids; rows that share an id count as one candidate with the best of their scores, and a query's own
id is never its neighbour. Rows equal in id and vector are folded before they are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored
from .texts import mix

CURVES, DIMS, BITS = 6, 3, 16
#: Of the order, how much a query sees on either side.
SHARE = 0.15
SLICES, SLICE_ROWS, QUERY_ROWS = 16, 8192, 8192
#: Rows from which means, deviations and slice bounds are taken.
SAMPLE = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits; dims * bits may be at most 63."""
    x = np.ascontiguousarray(cells.astype(np.uint64).T)
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and reflections of each level, coarse to fine
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (x[i] >> np.uint64(level)) & np.uint64(1)
    return key


class Curves:
    """Projections, shifts and slice bounds, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, longest: float, slices: int, curves: int, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        self.longest = longest
        wide = self.widen(sample)
        self.project, self.mean, self.scale, self.shift, self.bounds = [], [], [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(wide.shape[1], dims)))[0]
            flat = wide @ turn
            self.project.append(turn)
            self.mean.append(flat.mean(axis=0))
            self.scale.append(np.maximum(flat.std(axis=0), 1e-300))
            self.shift.append(rng.uniform(-0.5, 0.5, size=dims))
        for c in range(curves):
            key, tie = self.keys(c, wide), self.ties(c, ids)
            order = np.lexsort((tie, key))
            cut = order[(np.arange(1, slices) * len(order)) // slices]
            self.bounds.append((key[cut], tie[cut]))

    def widen(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The vectors with all lengths made equal."""
        size = np.linalg.norm(x, axis=1)
        if query:
            return np.c_[x * (self.longest / size)[:, None], np.zeros(len(x))]
        return np.c_[x, np.sqrt(np.maximum(self.longest**2 - size**2, 0))]

    def keys(self, curve: int, wide: np.ndarray) -> np.ndarray:
        place = (wide @ self.project[curve] - self.mean[curve]) / self.scale[curve] + self.shift[curve]
        cells = np.clip((place + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, BITS)

    def ties(self, curve: int, ids: np.ndarray) -> np.ndarray:
        """The order of equal keys, another one on each curve."""
        return mix(ids.astype(np.uint64) ^ mix(np.array([curve + 1], np.uint64)))

    def slices(self, curve: int, wide: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The slice of each vector: how many bounds are at or below its (key, tie)."""
        key, tie = self.keys(curve, wide), self.ties(curve, ids)
        bound, bound_tie = self.bounds[curve]
        first, last = np.searchsorted(bound, key, side="left"), np.searchsorted(bound, key, side="right")
        at = first.copy()
        for i in np.flatnonzero(first < last):  # bounds that only the tie tells apart
            at[i] += np.searchsorted(bound_tie[first[i] : last[i]], tie[i], side="right")
        return at


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors of one dimension as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k nearest ids: id, ids, best score of each; nearest first, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    slack = 1e-12 * np.linalg.norm(vectors, axis=1).max(initial=0)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        score = part @ vectors.T
        score[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if len(first) > k:
            top = score if len(first) == len(ids) else np.maximum.reduceat(score, first, axis=1)
            least = -np.partition(-top, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(part), -np.inf)
        for i, row in enumerate(score):
            near = np.flatnonzero((row >= least[i] - slack * np.linalg.norm(part[i])) & (row > -np.inf))
            exact = np.einsum("ij,j->i", vectors[near], part[i])
            best = np.lexsort((ids[near], -exact))
            if len(first) < len(ids):
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
            best = best[:k]
            yield int(query_ids[at + i]), ids[near][best], exact[best]


def search(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, curves: int = CURVES,
    dims: int = DIMS, share: float = SHARE, sample: int = SAMPLE, seed: int = 7,
) -> DataFrame:
    """query_id, rank, id, score of each query's k nearest other vectors."""
    every = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    every = every.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("q", F.coalesce("q", F.lit(False)))
    every = stored(every.groupBy("id", "v").agg(F.max("q").alias("q")), "vectors")
    sizes = every.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.col("q").cast("long")).alias("queries"),
        F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    ).orderBy(F.desc("n"), "dim").limit(1).collect()
    out = "query_id long, rank int, id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dim, n, different, asked, longest = sizes[0]
    every = every.where(F.size("v") == dim)
    # a slice alone holds more than k ids, so that no query finds fewer; many rows an id still make slices of bounded size
    needed = math.ceil(n / SLICE_ROWS)
    slices = max(1, min(max(SLICES, needed), n // (2 * (k + 1)), max(needed, different // (2 * (k + 1)))))
    around = math.ceil(share * slices - 0.5)
    parts = max(1, math.ceil(asked * (2 * around + 1) / slices / QUERY_ROWS))
    rows = every.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toPandas()
    fitted = Curves(np.stack(rows["v"].to_numpy()).astype(float), rows["id"].to_numpy(), longest, slices, curves, dims, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(number), dim)
            ask = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            wide, wide_ask = fitted.widen(x), fitted.widen(x[ask], query=True)
            spread = (mix(number[ask].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            body = np.array([r.tobytes() for r in x], dtype=object)
            for c in range(curves):
                place = fitted.slices(c, wide, number)
                for p in range(parts):
                    yield _dealt(c, place, np.full(len(number), p), False, number, body)
                place = fitted.slices(c, wide_ask, number[ask])
                for step in range(-around, around + 1):
                    there = (place + step >= 0) & (place + step < slices)
                    yield _dealt(c, place[there] + step, spread[there], True, number[ask][there], body[ask][there])

    def rank(table: pa.Table) -> pa.Table:
        ask = table["asks"].to_numpy()
        number, x = table["id"].to_numpy(), matrix(table["v"])
        found = list(nearest(number[~ask], x[~ask], number[ask], x[ask], k)) if ask.any() and not ask.all() else []
        return pa.table({
            "query_id": pa.array([a for a, _, _ in found], pa.int64()),
            "found": pa.array([[{"id": int(i), "far": -float(s)} for i, s in zip(b, c, strict=True)] for _, b, c in found], pa.list_(pa.struct([("id", pa.int64()), ("far", pa.float64())]))),
        })

    dealt = every.mapInArrow(deal, "curve int, slice int, part int, asks boolean, id long, v binary")
    best = dealt.groupBy("curve", "slice", "part").applyInArrow(rank, "query_id long, found array<struct<id:long,far:double>>")
    merged = best.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    # by id and distance: the first of each id is its best
    once = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1).id != x.id))
    ranked = F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x.far.alias("far"), x.id.alias("id")))), 1, k)
    return merged.select("query_id", ranked.alias("found")).select("query_id", F.posexplode("found").alias("rank", "r")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("r.id").alias("id"), (-F.col("r.far")).alias("score")
    )


def _dealt(curve: int, place: np.ndarray, part: np.ndarray, asks: bool, number: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    n = len(number)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, curve, np.int32)), pa.array(place.astype(np.int32)), pa.array(part.astype(np.int32)),
            pa.array(np.full(n, asks)), pa.array(number), pa.array(body.tolist(), pa.binary()),
        ],
        names=["curve", "slice", "part", "asks", "id", "v"],
    )


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = search(vectors, F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")
