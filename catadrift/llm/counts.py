"""Token counts without encoding: words that are one token are looked up, only the others are merged.

Before any text is read, each vocabulary string is tried by itself: it is a *whole* token if the pre-tokeniser leaves it
in one piece and merging its bytes ends in that one id. Merges never look beyond a word (pre-token), so wherever such a
string is a word of a text it counts one, whatever stands around it. Texts are cut into words; whole ones are counted
straight from the table, the rest once per distinct word by merge rounds.

The table has an entry per vocabulary string at most and travels to the tasks with the function. Texts are worked on in
lots, and words already merged are remembered up to a fixed number; no row is shuffled.

Edge cases: a null or empty text has no bytes and no tokens; strings of special tokens inside texts are one token each, as
in the library; rows that share an id are counted each by itself; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import flat
from .tokens import Bpe, default_path, lots, slices

#: Tokens above which a document is over the limit.
LIMIT = 512
#: Merged words that a task remembers before it forgets them all.
REMEMBERED = 200_000


def whole_tokens(bpe: Bpe) -> dict[str, int]:
    """The vocabulary strings that are one token by themselves, each with its count of 1."""
    ids, names = [], []
    for i, body in enumerate(bpe.bytes):
        try:
            name = body.decode()
        except UnicodeDecodeError:  # a part of a character is never a word
            continue
        if name not in bpe.special and bpe.words.findall(name) == [name]:
            ids.append(i)
            names.append(name)
    symbols, sizes = merged(bpe, names)
    begin = np.cumsum(sizes) - sizes
    alone = (sizes == 1) & (symbols[np.minimum(begin, len(symbols) - 1)] == np.array(ids))
    return {name: 1 for name, one in zip(names, alone.tolist(), strict=True) if one}


def merged(bpe: Bpe, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, one after the other, and how many each has."""
    plain = [w.encode() for w in words]
    return bpe.merge(np.frombuffer(b"".join(plain), np.uint8), np.array([len(w) for w in plain], dtype=np.int64))


class Counter:
    """Counts tokens of texts with a table of whole tokens and merges for the rest."""

    def __init__(self, bpe: Bpe, whole: dict[str, int]):
        self.bpe, self.whole, self.merged = bpe, whole, {}

    def count(self, texts: list[str]) -> list[int]:
        whole, known, cut = self.whole, self.merged, self.bpe.cut
        totals, rests, missing = [], [], {}
        for text in texts:
            special = 0
            if cut is not None and cut.search(text):
                parts = cut.split(text)
                special = len(parts) - 1
                words = [w for part in parts for w in self.bpe.words.findall(part)]
            else:
                words = self.bpe.words.findall(text)
            direct = sum(map(whole.get, words, repeat(0)))
            rest = [w for w in words if w not in whole] if direct < len(words) else []
            missing.update((w, None) for w in rest if w not in known)
            totals.append(special + direct)
            rests.append(rest)
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                missing = dict.fromkeys(w for rest in rests for w in rest)
                known = self.merged = {}
            names = list(missing)
            known.update(zip(names, merged(self.bpe, names)[1].tolist(), strict=True))
        return [n + sum(map(known.__getitem__, rest)) for n, rest in zip(totals, rests, strict=True)]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of each document, by the byte-level BPE tokenizer of the file."""
    bpe = Bpe(path)
    table = docs.sparkSession.sparkContext.broadcast((bpe, whole_tokens(bpe)))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*table.value)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [n for a, b in lots(texts) for n in counter.count(texts[a:b])]
            size = np.diff(flat(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The counts with a mark for documents of more tokens than the limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return over_limit(token_counts(docs, default_path())).withColumnRenamed("id", "doc_id")
