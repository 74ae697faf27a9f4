"""Language identification by a linear-chain conditional random field over words.

Each word of a sentence has a label. Its features are the word itself (lexicon), its affixes (first three, last two and
last three bytes) and its three-byte sequences; labels of neighbours are tied by learned transitions. Forward-backward
gives each word's label probabilities, so text that switches languages is labelled word by word: spans are runs of words
with one most probable label. A document's language is the label with the largest mean probability over its words, and
that mean its score.

The model is trained on a bounded sample of labelled documents by maximum likelihood. Each training chain joins two
sentences of different documents, so that transitions see both staying and switching. Every label that occurs is learned;
the more there are, the fewer rows the table of weights has and the fewer words teach each of them, so that memory stays
the same. A label that has too few short texts learns from pieces of long ones.

Edge cases: a text that is null or has no letter is `und` with score 0 and no spans; without labelled documents every text is `und`;
rows whose label is null teach nothing. Every word of every text counts, in lots of bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import LOT_BYTES, Spans, byte_values, flat, letters, mix, text_lots

NO_LANGUAGE = "und"
#: Documents a language to learn from, characters of a piece of them, words and passes: bounds of the training.
PER_LANGUAGE, MAX_CHARS, MAX_WORDS, PASSES = 250, 20_000, 100_000, 30
#: Rows of the table of feature weights, as a power of two, and numbers of it and of words times labels, as such, at most.
TABLE_BITS, WEIGHT_BITS, MAX_CELLS = 17, 23, 6_400_000


def table_bits(labels: int) -> int:
    """Rows of the table for so many labels, as a power of two."""
    return min(TABLE_BITS, WEIGHT_BITS - max(0, labels - 1).bit_length())


class Words:
    """Words of a lot of texts: features, sentences, documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int = TABLE_BITS):
        self.start, self.end, self.doc = start, end, _ = letters(data, offsets)
        self.table = 1 << bits
        size = end - start
        spans = Spans(data, byte_values(fold=True))
        mask = np.uint64(self.table - 1)

        def row(hashes: np.ndarray, kind: int) -> np.ndarray:
            return (mix(hashes + np.uint64(kind)) & mask).astype(np.int64)

        self.rows = [
            row(spans.hash(start, end), 1), row(spans.hash(start, start + np.minimum(3, size)), 2),
            row(spans.hash(end - np.minimum(2, size), end), 3), row(spans.hash(end - np.minimum(3, size), end), 4),
        ]
        grams = spans.fixed(3)
        self.grams = row(grams, 5)
        self.gram_from = np.minimum(start, len(grams))
        self.gram_to = np.maximum(np.minimum(end - 2, len(grams)), self.gram_from)
        stop = (data == 46) | (data == 33) | (data == 63) | (data == 10)  # . ! ? and line ends
        stops = np.r_[0, np.cumsum(stop)]
        part = stops[start]
        self.new = np.r_[True, (part[1:] != part[:-1]) | (self.doc[1:] != self.doc[:-1])] if len(start) else np.zeros(0, bool)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.doc), weights.shape[1]))
        for row in self.rows:
            out += weights[row]
        if len(self.grams):
            sums = np.zeros((len(self.grams) + 1, weights.shape[1]))
            np.cumsum(weights[self.grams], axis=0, out=sums[1:])
            many = np.maximum(self.gram_to - self.gram_from, 1)[:, None]
            out += (sums[self.gram_to] - sums[self.gram_from]) / many
        return out

    def scatter(self, grad: np.ndarray) -> np.ndarray:
        """The gradient of the weights from that of the emissions."""
        out = np.zeros((self.table, grad.shape[1]))
        many = np.maximum(self.gram_to - self.gram_from, 1)[:, None]
        spread = np.zeros((len(self.grams) + 1, grad.shape[1]))
        for label in range(grad.shape[1]):
            for row in self.rows:
                out[:, label] += np.bincount(row, grad[:, label], self.table)
            share = (grad / many)[:, label] * (self.gram_to > self.gram_from)
            np.add.at(spread[:, label], self.gram_from, share)
            np.add.at(spread[:, label], self.gram_to, -share)
            if len(self.grams):
                out[:, label] += np.bincount(self.grams, np.cumsum(spread[:-1, label]), self.table)
        return out


def forward_backward(emit: np.ndarray, new: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities of each word, expected transitions, and log-likelihood's partition, over chains that begin at new."""
    n, labels = emit.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels)), 0.0
    top = emit.max(axis=1, keepdims=True)
    local, move = np.exp(emit - top), np.exp(moves)
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, n])
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    ahead, back, scale = np.empty((n, labels)), np.empty((n, labels)), np.empty(n)
    open_ = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains that have a t-th word
    for t in range(size[0]):
        at = begin[: open_[t]] + t
        value = local[at] * (np.exp(start) if t == 0 else ahead[at - 1] @ move)
        scale[at] = value.sum(axis=1)
        ahead[at] = value / scale[at][:, None]
    pairs = np.zeros((labels, labels))
    back[begin + size - 1] = 1.0
    for t in range(size[0] - 2, -1, -1):
        at = begin[: open_[t + 1]] + t
        after = local[at + 1] * back[at + 1] / scale[at + 1][:, None]
        back[at] = after @ move.T
        pairs += ahead[at].T @ after * move
    return ahead * back, pairs, float(np.log(scale).sum() + top.sum())


def train(texts: list[str], langs: list[str], passes: int = PASSES, max_words: int = MAX_WORDS, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Labels, feature weights, transitions and start weights."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    sentences = [(x, labels.index(lang)) for text, lang in zip(texts, langs, strict=True) for x in re.split(r"(?<=[.!?\n])", text) if re.search(r"\w", x)]
    taken = [0] * len(labels)
    turns = []  # labels take turns, so that each teaches
    for i in rng.permutation(len(sentences)):
        label = sentences[i][1]
        turns.append((taken[label], len(turns), i))
        taken[label] += 1
    chosen, total = [], 0
    for _, _, i in sorted(turns):
        if total > min(max_words, MAX_CELLS // max(1, len(labels))):
            break
        chosen.append(sentences[i])
        total += len(sentences[i][0].split())
    chosen = [chosen[i] for i in rng.permutation(len(chosen))]
    bits = table_bits(len(labels))
    data, offsets = flat(pa.array([x for x, _ in chosen], pa.string()))
    lot = Words(data, offsets, bits)
    truth = np.array([y for _, y in chosen], dtype=np.int64)[lot.doc]
    # a chain is two sentences in random order; they are of different documents as a rule
    new = np.r_[True, lot.doc[1:] // 2 != lot.doc[:-1] // 2] if len(lot.doc) else np.zeros(0, bool)
    k = len(labels)
    weights, moves, start = np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k)
    params = [weights, moves, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(k)[truth]
    stay = np.zeros((k, k))
    inner = np.flatnonzero(~new)
    np.add.at(stay, (truth[inner - 1], truth[inner]), 1)
    for step in range(1, passes + 1):
        prob, pairs, _ = forward_backward(lot.emissions(weights), new, moves, start)
        grads = [lot.scatter(prob - gold) + 0.01 * weights, pairs - stay + 0.01 * moves, (prob - gold)[new].sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):  # Adam
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return labels, weights.astype(np.float32), moves, start


def sample(docs: DataFrame, learn: Column, key: str, text: str, lang: str) -> list:
    """(text, label) rows to learn from, about PER_LANGUAGE a label and at most so many on average; pieces of long texts where short ones are few."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.withColumn("long", F.length("text") > MAX_CHARS)
    piece = F.expr(f"IF(long, substring(text, CAST(1 + pmod(xxhash64(text), length(text) - {MAX_CHARS}) AS INT), {MAX_CHARS}), text)")
    counts = known.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()  # a row per label, as the model has a column
    if not counts:
        return []
    wanted = {}
    for row in counts:
        left = max(0, PER_LANGUAGE - row["short"])
        wanted[row["lang"]] = (min(1.0, PER_LANGUAGE / max(1, row["short"])), min(1.0, left / max(1, row["long"])))
    short, long = (F.create_map(*[F.lit(x) for name, share in wanted.items() for x in (name, share[i])]) for i in (0, 1))
    even = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(even < F.when(F.col("long"), F.element_at(long, F.col("lang"))).otherwise(F.element_at(short, F.col("lang"))))
    return chosen.orderBy(even, "text").limit(PER_LANGUAGE * len(counts)).select(piece.alias("text"), "lang").collect()


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("probability", pa.float64())]))


def spans_of(lot: Words, prob: np.ndarray, body: np.ndarray, offsets: np.ndarray, labels: list[str], has: np.ndarray) -> list[list[dict]]:
    """By document, runs of words with one most probable label; places are code points of the document."""
    out: list[list[dict]] = [[] for _ in has]
    if not len(lot.doc):
        return out
    best = prob.argmax(axis=1)
    cut = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (lot.doc[1:] != lot.doc[:-1])])
    last = np.r_[cut[1:], len(best)] - 1
    mean = np.add.reduceat(prob[np.arange(len(best)), best], cut) / (last - cut + 1)
    chars = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
    doc = lot.doc[cut]
    begin = chars[offsets[doc]]
    places = zip(doc.tolist(), (chars[lot.start[cut]] - begin).tolist(), (chars[lot.end[last]] - begin).tolist(), best[cut].tolist(), mean.tolist(), strict=True)
    for d, start, end, label, p in places:
        if has[d]:
            out[d].append({"start": start, "end": end, "label": labels[label], "probability": min(1.0, p)})
    return out


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", spans: bool = False) -> DataFrame:
    """id, lang_pred and score of each document; learned from the rows where `learn` holds.

    With `spans`, also spans (start, end, label, probability): the languages of the words of a text that switches them.
    """
    rows = sample(docs, learn, key, text, lang)
    labels, weights, moves, start = train([r["text"] for r in rows], [r["lang"] for r in rows])
    model = docs.sparkSession.sparkContext.broadcast((weights, moves, start))  # its size is bounded by WEIGHT_BITS, and labels squared
    bits, lot_bytes = table_bits(len(labels)), max(20_000, LOT_BYTES * 16 // max(16, len(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in text_lots(offsets, lot_bytes):
                n = b - a
                best, score, has = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
                body, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                lot = Words(body, places, bits)
                if len(lot.doc) and labels:
                    weights, moves, start = model.value
                    prob = forward_backward(lot.emissions(weights), lot.new, moves, start)[0]
                    mean = np.stack([np.bincount(lot.doc, prob[:, k], n) for k in range(len(labels))], axis=1)
                    words = np.bincount(lot.doc, minlength=n)
                    has = words > 0
                    plain = np.r_[0, np.cumsum(((body | 32) >= 97) & ((body | 32) <= 122))]
                    for i in np.flatnonzero(has & (plain[places[1:]] == plain[places[:-1]])):
                        has[i] = any(c.isalpha() for c in batch.column(1)[a + int(i)].as_py())
                    mean[has] /= words[has][:, None]
                    best[has], score[has] = mean[has].argmax(axis=1), np.clip(mean[has].max(axis=1), 0, 1)
                columns = [batch.column(0).slice(a, n), pa.array([labels[x] if x >= 0 else NO_LANGUAGE for x in best], pa.string()), pa.array(score)]
                if spans:
                    columns.append(pa.array(spans_of(lot, prob, body, places, labels, has) if has.any() else [[]] * n, SPANS))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "spans"][: len(columns)])

    more = ", spans array<struct<start:long,end:long,label:string,probability:double>>" if spans else ""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[key]}, lang_pred string, score double{more}")


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fold("doc_id", 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")
