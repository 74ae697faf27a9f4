"""Byte-level BPE encoding and decoding by batched merge rounds.

The distinct words (pre-tokens) of a batch stand in one flat array of symbols. A round looks up the rank of every pair of
neighbours of a word by binary search over the sorted pair keys, merges in each word the pairs of its lowest rank (from
the left where they overlap), and closes the gaps. Words leave when no pair has a rank. Pairs that a merge creates have
higher ranks than the merge itself, so merging all places of the lowest rank at once equals merging them one by one.

Each batch is worked on by itself, in bounded memory; no row is shuffled. Vocabulary and merges travel to the tasks once
each, with the function; their size is that of the tokenizer file.

Edge cases: a null or empty text has no ids and decodes to an empty text; texts of the special tokens become their ids,
as in the library; ids that aren't whole UTF-8 decode with replacement characters. Other columns are carried along.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 62)
#: Texts are worked on in lots of about so many characters (a longer text is a lot of its own) and at most so many rows.
LOT, ROWS = 1_000_000, 256


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def newer_signs() -> str:
    """Letters and numbers of newer Unicode versions that the regex module knows and the tokenizers library doesn't, as ranges."""
    from tokenizers import pre_tokenizers

    cut, known = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str, regex.compile(r"[\p{L}\p{N}]")
    new = (c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c))
    at = np.array([ord(c) for c in new if len(cut("a" + c)) == 2 == len(cut("1" + c))], dtype=np.int64)
    head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return "".join(f"\\U{at[a]:08X}-\\U{at[b - 1]:08X}" for a, b in zip(head, [*head[1:], len(at)], strict=True))


class Pretokens:
    """Cuts texts into words (pre-tokens) as the tokenizers library does."""

    def __init__(self):
        self.plain, self.new, self.exact = regex.compile(PATTERN), None, None
        if new := newer_signs():
            letter, number, other = rf"[\p{{L}}--[{new}]]", rf"[\p{{N}}--[{new}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{new}]]"
            self.new = {chr(c) for x in regex.findall(r"\\U(\w{8})-\\U(\w{8})", new) for c in range(int(x[0], 16), int(x[1], 16) + 1)}
            self.exact = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r" ?\p{L}", f" ?{letter}").replace(r" ?\p{N}", f" ?{number}"))

    def findall(self, text: str) -> list[str]:
        if self.new is None or text.isascii() or self.new.isdisjoint(text):
            return self.plain.findall(text)
        return self.exact.findall(text)


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        names, vocab = byte_names(), file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for word, i in vocab.items():
            self.bytes[i] = bytes(names[c] for c in word) if all(c in names for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.single = np.array([vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = Pretokens()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as bytes in one array, and how many each word has."""
        symbols = self.single[symbols]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [], []
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            begin = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, begin)
            count = np.diff(np.r_[begin, len(symbols)])
            open_ = np.repeat(lowest < NONE, count)
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                lowest = np.repeat(lowest, count)[open_]
                symbols, word, rank = symbols[open_], word[open_], rank[open_]
            else:
                lowest = np.repeat(lowest, count)
            hit = rank == lowest
            # of neighbouring hits (they overlap) every second one counts, from the left
            first = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0)) if len(hit) else np.zeros(0, np.int64)
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            symbols = np.where(hit, self.merged[np.where(hit, rank, 0)], symbols)
            stay = ~np.r_[False, hit[:-1]] if len(hit) else hit
            symbols, word = symbols[stay], word[stay]
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))

    def pieces(self, text: str) -> Iterator[str | int]:
        """The words of a text; special tokens as their ids."""
        if self.cut is None:
            yield from self.words.findall(text)
            return
        at = 0
        for found in self.cut.finditer(text):
            yield from self.words.findall(text[at : found.start()])
            yield self.special[found[0]]
            at = found.end()
        yield from self.words.findall(text[at:] if at else text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        number: dict[str | int, int] = {}
        uses = [np.fromiter((number.setdefault(p, len(number)) for p in self.pieces(t)), np.int64) for t in texts]
        plain = [p.encode("utf-8", "replace") if isinstance(p, str) else b"" for p in number]
        sizes = np.array([len(p) for p in plain], dtype=np.int64)
        symbols, counts = self.merge(np.frombuffer(b"".join(plain), np.uint8), sizes)
        for p, i in number.items():
            if isinstance(p, int):
                counts[i] = 1
        ends = np.cumsum(counts)
        if any(isinstance(p, int) for p in number):
            full = np.zeros(int(ends[-1]), np.int64)
            special = np.zeros(len(full), bool)
            for p, i in number.items():
                if isinstance(p, int):
                    full[ends[i] - 1], special[ends[i] - 1] = p, True
            full[~special] = symbols
            symbols = full
        out = []
        for use in uses:
            many = counts[use]
            total = int(many.sum())
            shift = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            out.append(symbols[np.repeat(ends[use] - many, many) + shift].astype(np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about LOT characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > LOT:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encoder(bpe: Broadcast[Bpe], text: str, out: str):
    """Adds the ids of a column's texts to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found = [x.astype("<u4").tobytes() for a, b in lots(texts) for x in bpe.value.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return run


def decoder(bpe: Broadcast[Bpe], ids: str, out: str):
    """Adds the texts of a column's ids to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [bpe.value.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The documents with a further column: the ids as little-endian unsigned 32-bit integers."""
    bpe = docs.sparkSession.sparkContext.broadcast(Bpe(path))
    return docs.mapInArrow(encoder(bpe, text, out), T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with a further column: the text of the ids."""
    bpe = rows.sparkSession.sparkContext.broadcast(Bpe(path))
    return rows.mapInArrow(decoder(bpe, ids, out), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """What decode() makes of encode(), without the given texts, in one Python worker a task.

    One after the other they take two workers a task, and executors keep these, with their memory, for whatever runs next.
    """
    bpe = docs.sparkSession.sparkContext.broadcast(Bpe(path))
    there, back = encoder(bpe, text, ids), decoder(bpe, ids, out)
    fields = [*[f for f in docs.schema.fields if f.name != text], T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in back(there(batches)):
            yield batch.select(names)

    return docs.mapInArrow(run, T.StructType(fields))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256, and the decoded text's digest."""
    docs = docs.select(F.col(key), F.col(text).alias("text_to_encode"))
    done = round_trip(docs, path, "text_to_encode")
    return done.select(
        key, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path()).drop("ids")
