"""Toxicity by a counterfactually regularised classifier.

A logistic model over the distinct words and word beginnings of a text, hashed into a table of weights. Training adds to
the loss of the labels a penalty on counterfactual pairs: sentences of labelled documents that mention a group, beside
copies in which the term is swapped for every other term of its kind. The score of a text should not change with the
group it mentions, so the model can't learn a group's name as a sign of toxicity, and neutral mentions stay clean.

The model is trained on a bounded sample of labelled documents, and its intercept put right for the shares of the classes
in that sample; every document is scored over its whole text.

Edge cases: a null or empty text has no features and gets the score of the intercept; without labelled rows every score
is next to 0; labels other than 0 and 1 and null labels teach nothing; a document that has several
label rows is toxic if one says so.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh
from .languages import fold
from .texts import Spans, byte_values, flat, letters, mix, text_lots

#: Terms of a kind are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "foreigners", "natives"),
    ("young", "old", "elderly"), ("disabled", "deaf", "blind"),
)
#: Largest numbers of labelled documents of each class to learn from, and their largest length.
PER_CLASS, MAX_CHARS = {1: 2000, 0: 5000}, 20_000
#: Counterfactual pairs to learn from, at most; weight of their penalty.
MAX_PAIRS, PENALTY = 20_000, 5.0
TABLE_BITS, PASSES, RIDGE = 18, 300, 0.05
#: Features whose rates in toxic and clean documents differ by fewer standard errors say nothing and get no weight.
LEAST_Z = 3.5
#: Lengths in bytes of the word beginnings used.
BEGINNINGS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, row of the table) of the distinct features of each document."""
    start, end, doc = letters(data, offsets)
    spans = Spans(data, byte_values(fold=True))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    keys = []
    for kind, length in enumerate((1 << 62, *BEGINNINGS)):
        long = end - start > length if kind else np.ones(len(start), bool)  # a shorter word is its own beginning
        hashes = spans.hash(start[long], np.minimum(start[long] + length, end[long]))
        keys.append(doc[long].astype(np.uint64) << np.uint64(TABLE_BITS) | mix(hashes + np.uint64(kind > 0)) & mask)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(TABLE_BITS)).astype(np.int64), (key & mask).astype(np.int64)


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """features() of a list of texts, lot by lot."""
    data, offsets = flat(pa.array(texts, pa.string()))
    lots = []
    for a, b in text_lots(offsets):
        doc, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        lots.append(((doc + a).astype(np.int32), row.astype(np.int32)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (zip(*lots, strict=True) if lots else ((), ())))


def counterfactuals(texts: list[str], kinds=IDENTITY, limit: int = MAX_PAIRS) -> tuple[list[str], list[str]]:
    """Sentences that name a group, and the same with another group of the kind; if over limit, drawn by hash of the place."""
    others = {term: [x for x in kind if x != term] for kind in kinds for term in kind}
    if not others:
        return [], []
    term = re.compile(r"(?i)(?<!\w)(" + "|".join(sorted(map(re.escape, others), key=len, reverse=True)) + r")(?!\w)")
    drawn: list[tuple[int, int, str, str]] = []  # a heap, largest hash first
    place = 0
    for text in texts:
        for sentence in re.split(r"(?<=[.!?\n])", text):
            for found in term.finditer(sentence):
                for other in others[found[0].lower()]:
                    place += 1
                    turn = -int.from_bytes(hashlib.blake2b(b"%d" % place, digest_size=8).digest(), "big")
                    if len(drawn) < limit or drawn and turn > drawn[0][0]:
                        pair = (turn, place, sentence, sentence[: found.start()] + other + sentence[found.end() :])
                        heapq.heappush(drawn, pair) if len(drawn) < limit else heapq.heapreplace(drawn, pair)
    drawn.sort(key=lambda x: x[1])
    return [x[2] for x in drawn], [x[3] for x in drawn]


def _sums(doc: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights[row], n)


def train(texts: list[str], toxic: list[int], kinds=IDENTITY, penalty: float = PENALTY, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    weights, bias = np.zeros(1 << TABLE_BITS), -20.0
    truth = np.array(toxic, float)
    if not len(truth):
        return weights.astype(np.float32), bias
    bias = float(np.log((truth.sum() + 0.5) / (len(truth) - truth.sum() + 0.5)))
    doc, row = text_features(texts)
    n1, n0 = max(truth.sum(), 1), max(len(truth) - truth.sum(), 1)
    seen, with_1 = np.bincount(row, minlength=len(weights)), np.bincount(row, truth[doc], len(weights))
    rate = seen / len(truth)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    told = np.abs(with_1 / n1 - (seen - with_1) / n0) >= LEAST_Z * error
    doc, row = doc[told[row]], row[told[row]]
    said, swapped = counterfactuals(texts, kinds)
    pairs = [text_features(x) for x in (said, swapped)]
    pairs = [(d[told[r]], r[told[r]]) for d, r in pairs]
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    size = len(weights)
    for step in range(1, passes + 1):
        score = 1 / (1 + np.exp(-np.clip(_sums(doc, row, weights, len(truth)) + bias, -30, 30)))
        off = score - truth
        grad = np.r_[np.bincount(row, off[doc], size) + RIDGE * weights, off.sum()]
        if said:
            change = _sums(*pairs[0], weights, len(said)) - _sums(*pairs[1], weights, len(said))
            change *= 2 * penalty * len(truth) / len(said)
            grad[:-1] += np.bincount(pairs[0][1], change[pairs[0][0]], size) - np.bincount(pairs[1][1], change[pairs[1][0]], size)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights.astype(np.float32), float(bias)


def sample(docs: DataFrame, labels: DataFrame, learn, key: str, text: str) -> tuple[list, float]:
    """(text, toxic) rows to learn from, of each class at most PER_CLASS, and how far the sample's log odds are below the true."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.where(learn("k")).groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, most in PER_CLASS.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(1, counts.get(label, 0))))).otherwise(share)
    even = F.pmod(F.xxhash64(F.lit(13), "k"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(learn("k")).where(even < share).orderBy(even, "k").limit(sum(PER_CLASS.values()))
    short = docs.where(F.col(text).isNotNull() & (F.length(text) <= MAX_CHARS)).select(F.col(key).alias("k"), F.col(text).alias("text"))
    # at most sum(PER_CLASS) keys, as a list in the plan: no document is shuffled for the sample
    keys = {r["k"]: r["toxic"] for r in chosen.collect()}
    rows = short.where(F.col("k").isin(list(keys))).limit(2 * sum(PER_CLASS.values())).collect() if keys else []
    taken = Counter(keys.values())
    below = np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0]) if taken[0] and taken[1] else 0.0
    return sorted((r["text"], keys[r["k"]]) for r in rows), float(below)


def scored(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", out: str = "score", kinds=IDENTITY, penalty: float = PENALTY) -> DataFrame:
    """The documents with a further column: the probability of being toxic. learn(name of the id) marks the rows to learn from."""
    rows, below = sample(docs, labels, learn, key, text)
    weights, bias = train([t for t, _ in rows], [y for _, y in rows], kinds, penalty)
    bias += below if rows else 0.0
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 1 MB, by TABLE_BITS
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            data, offsets = flat(batch.column(place))
            score = np.zeros(batch.num_rows)
            for a, b in text_lots(offsets):
                doc, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score[a:b] = 1 / (1 + np.exp(-np.clip(_sums(doc, row, weights, b - a) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score is below `least`, as they are; learned from the rows outside the held-out fold."""
    score = fresh(docs, "toxicity")
    found = scored(docs, labels, lambda name: fold(name, 5) != 0, key, text, score)
    return found.where(F.col(score) < least).drop(score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = scored(docs, labels, lambda name: fold(name, 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
