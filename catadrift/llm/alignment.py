"""Alignment of two tokenizers over the same texts, by anchors at white space.

Each text is tokenised whole by both: A is byte-level BPE, B a SentencePiece BPE model. Tokens are runs of bytes of the
same byte string, a space and the text. Where an A token and a B token both begin with a space at one byte offset, what
stands before is a shared end of both; these verified anchors cut a document into windows, a word or so each. A window's
alignment depends on its token ids only, so it is worked out once per pair of id tuples and remembered: groups between
shared ends, and links, the pairs of an A and a B token whose bytes overlap.

Tokenising looks up remembered pieces too. No merge of A crosses a pre-token, and none of B crosses a space that follows
something else, since no piece of the vocabulary holds one there (checked when it is read), so that pieces encoded by
themselves give the ids of the whole text.

How many documents hold a pair of ids linked is counted over the corpus: blocks of documents are written to the shared
folder, with each document's links as numbers into the block's distinct pairs; the pairs go with their counts to the
partition of their A id, which adds them up, finds the highest count of each A id, and answers the blocks. A pair moves
once per block, however many documents hold it; no table of pairs is broadcast.

Edge cases: a text that is null or empty, or whose A or B tokens don't join to a space and the text (it holds U+2581, or
characters that B drops), has no tokens, zeros, and no groups; strings of special tokens are plain text; rows that share an
id are documents by themselves; a null id stays null.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import merged
from .frames import NO_ID, fresh, ids, packed, partitions, scratch, unpacked
from .texts import BASE, Spans, mix
from .tokens import Bpe, default_path, lots, slices

PIECES = "piece_bpe_32k.model"
#: Characters of pieces, and windows, that a task remembers before it forgets them all.
PIECE_CHARS, WINDOWS = 16_000_000, 400_000
#: Bytes of text of a block.
BLOCK_BYTES = 8_000_000


class Pieces:
    """A SentencePiece BPE model, from the bytes of its file."""

    def __init__(self, model: bytes):
        self.model = model
        library = self.library()
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece holds a space after something else, so texts can't be cut at spaces")
        self.size, self.space = len(names), library.piece_to_id("▁")
        self.cut = regex.compile(r" +[^ ]*")

    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def split(self, text: str) -> list[str]:
        """The parts of a space and the text that begin with spaces, each without its first space."""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in self.cut.findall(" " + text)]
        return text.split(" ")

    def encoder(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        library = self.library()

        def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [x or [self.space] for x in library.encode(parts, num_threads=1)]
            return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], dtype=np.int64)

        return encode


class Remembered:
    """The ids of pieces of text, each encoded once."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.number, self.chars, self.ids, self.ends = {}, 0, array("q"), array("q", [0])

    def tokens(self, uses: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as pieces, one after the other, and how many each text has."""
        every = set(chain.from_iterable(uses))
        missing = every.difference(self.number)
        if missing:
            if self.chars > PIECE_CHARS:
                self.forget()
                missing = every
            found, sizes = self.encode(list(missing))
            self.number.update(zip(missing, range(len(self.number), len(self.number) + len(missing)), strict=True))
            self.chars += sum(map(len, missing)) + 8 * len(missing)
            last = self.ends[-1]
            self.ids.frombytes(found.astype(np.int64).tobytes())
            self.ends.frombytes((last + np.cumsum(sizes)).astype(np.int64).tobytes())
        use = np.fromiter(map(self.number.__getitem__, chain.from_iterable(uses)), np.int64)
        found, many = ragged(np.frombuffer(self.ids, np.int64), np.frombuffer(self.ends, np.int64), use)
        edge = np.cumsum([0, *map(len, uses)])
        return found, np.diff(np.r_[0, np.cumsum(many)][edge])


def ragged(values: np.ndarray, ends: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the used rows, and how many each has; row i of values ends at ends[i + 1]."""
    begin = ends[use]
    many = ends[use + 1] - begin
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return values[np.repeat(begin, many) + at], many


class Table:
    """Bytes of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        self.ends = np.r_[0, np.cumsum(self.sizes)]
        self.values = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in tokens])

    def joined(self, ids: np.ndarray) -> bytes:
        return ragged(self.values, self.ends, ids)[0].tobytes()


class Documents:
    """What a lot of documents has: arrays by document, and its links as (document, code, times) in order."""

    def __init__(self, n: int):
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.groups = [""] * n
        self.owner, self.codes, self.times = (np.zeros(0, np.int64) for _ in range(3))


class Aligner:
    """Tokenises texts by both sides and aligns them; remembers pieces and windows."""

    def __init__(self, a: Bpe, b: Pieces):
        self.a, self.b = a, b
        self.table_a, self.table_b = Table(a.bytes), Table(b.bytes)
        self.memory_a, self.memory_b = Remembered(lambda words: merged(a, words)), Remembered(b.encoder())
        # how an id is shown inside a group, at the end of its side and, on side B, at the end of a window
        self.spelled_a = np.array([[f"{i}{x}" for i in range(len(a.bytes))] for x in ",|"], dtype=object)
        self.spelled_b = np.array([[f"{i}{x}" for i in range(b.size)] for x in ",; "], dtype=object)
        self.values_a, self.values_b = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) for n in (len(a.bytes), b.size))
        self.forget()

    def forget(self) -> None:
        self.number, self.shown, self.counts = {}, [], array("q")
        self.pairs, self.ends = array("q"), array("q", [0])

    def learn(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Align windows given one after the other, with how many tokens each has: groups as text, how many, and links as codes."""
        size_a, size_b = self.table_a.sizes[a], self.table_b.sizes[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last = np.searchsorted(shared, end_a[np.cumsum(n_a) - 1])  # the last group of each window
        # a group's A tokens come first, then its B tokens; what follows a token tells where it stands
        many_a, many_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        spell_a, spell_b = self.spelled_a, self.spelled_b
        close_a, close_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True].astype(np.int64)
        final = np.zeros(len(shared), bool)
        final[last] = True
        close_b[(close_b == 1) & final[group_b]] = 2
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = spell_a[close_a.astype(np.int64), a]
        out[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = spell_b[close_b, b]
        self.shown += "".join(out.tolist()).split(" ")[:-1]
        self.counts.frombytes(np.diff(last, prepend=-1).astype(np.int64).tobytes())
        # an A token overlaps the B tokens from the one that ends after its begin to the first that ends at its end or later
        first = np.searchsorted(end_b, end_a - size_a, side="right")
        many = np.searchsorted(end_b, end_a) - first + 1
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        codes = np.repeat(a, many) * self.b.size + b[np.repeat(first, many) + at]
        links = np.add.reduceat(many, np.cumsum(n_a) - n_a)
        self.pairs.frombytes(codes.astype(np.int64).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(links)).astype(np.int64).tobytes())

    def windows(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """The number of each window's alignment."""
        if len(self.number) > WINDOWS:
            self.forget()
        known = self.number
        code = Spans(a, self.values_a).hash(cut_a[:-1], cut_a[1:]) * np.uint64(BASE) + Spans(b, self.values_b).hash(cut_b[:-1], cut_b[1:])
        _, one, same = np.unique(code, return_index=True, return_inverse=True)
        odd = self.differ(a, cut_a, one[same]) | self.differ(b, cut_b, one[same])
        if odd.any():  # hashes that meet by chance: these windows stand for themselves
            same = same.copy()
            same[odd] = len(one) + np.arange(int(odd.sum()))
            one = np.r_[one, np.flatnonzero(odd)]
        bytes_a, bytes_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        keys = [
            (bytes_a[p:q], bytes_b[r:t])
            for p, q, r, t in zip(*((4 * x).tolist() for x in (cut_a[one], cut_a[one + 1], cut_b[one], cut_b[one + 1])), strict=True)
        ]
        new = {k: i for i, k in enumerate(keys) if k not in known}
        if new:
            at = one[list(new.values())]
            parts = [ragged(x, cut, at) for x, cut in ((a, cut_a), (b, cut_b))]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.learn(parts[0][0], parts[1][0], parts[0][1], parts[1][1])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[same]

    @staticmethod
    def differ(ids: np.ndarray, cut: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which windows have other ids than the windows named for them."""
        size = np.diff(cut)
        out = size != size[other]
        many = np.where(out, 0, size)
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        wrong = ids[np.repeat(cut[:-1], many) + at] != ids[np.repeat(cut[other], many) + at]
        out[np.repeat(np.arange(len(size)), many)[wrong]] = True
        return out

    def documents(self, texts: list[str | None]) -> Documents:
        out = Documents(len(texts))
        at = [i for i, x in enumerate(texts) if x]
        if not at:
            return out
        plain = [texts[i] for i in at]
        a, n_a = self.memory_a.tokens([self.a.words.findall(" " + x) for x in plain])
        b, n_b = self.memory_b.tokens([self.b.split(x) for x in plain])
        raw = [b" " + x.encode("utf-8", "replace") for x in plain]
        good = self.exact(self.table_a, a, n_a, raw) & self.exact(self.table_b, b, n_b, raw)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        at, n_a, n_b = np.array(at, dtype=np.int64)[good], n_a[good], n_b[good]
        if not len(at):
            return out
        size_a, size_b = self.table_a.sizes[a], self.table_b.sizes[b]
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        anchors = np.intersect1d(start_a[self.table_a.spaced[a]], start_b[self.table_b.spaced[b]], assume_unique=True)
        cut_a, cut_b = np.r_[np.searchsorted(start_a, anchors), len(a)], np.r_[np.searchsorted(start_b, anchors), len(b)]
        window = self.windows(a, b, cut_a, cut_b)
        first = np.searchsorted(cut_a, np.cumsum(n_a) - n_a)  # a document begins with a space, so a window begins with it
        edge = np.r_[first, len(window)]
        doc = np.repeat(np.arange(len(at)), np.diff(edge))
        codes, many = ragged(np.frombuffer(self.pairs, np.int64), np.frombuffer(self.ends, np.int64), window)
        out.n_a[at], out.n_b[at] = n_a, n_b
        out.n_groups[at] = np.add.reduceat(np.frombuffer(self.counts, np.int64)[window], first)
        out.n_links[at] = np.add.reduceat(many, first)
        shown = [self.shown[w] for w in window.tolist()]
        for i, p, q in zip(at.tolist(), edge.tolist(), edge[1:].tolist(), strict=False):
            out.groups[i] = ";".join(shown[p:q])
        owner = at[np.repeat(doc, many)]
        order = np.lexsort((codes, owner))
        owner, codes = owner[order], codes[order]
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])])
        out.owner, out.codes, out.times = owner[cut], codes[cut], np.diff(np.r_[cut, len(codes)])
        return out

    @staticmethod
    def exact(table: Table, ids: np.ndarray, many: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which texts their tokens join to."""
        joined = table.joined(ids)
        size = np.r_[0, np.cumsum(table.sizes[ids])][np.r_[0, np.cumsum(many)]].tolist()
        return np.array([joined[p:q] == x for p, q, x in zip(size, size[1:], raw, strict=False)], dtype=bool)


def sides(docs: DataFrame, path_a: str, path_b: str):
    """Both tokenizers, as a value for all tasks; their sizes are those of their files."""
    return docs.sparkSession.sparkContext.broadcast((Bpe(path_a), Pieces(Path(path_b).read_bytes())))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The documents with n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`) and links, the distinct (a, b) with how often."""
    both = sides(docs, path_a, path_b)
    link = T.StructType([T.StructField(x, T.LongType()) for x in ("a", "b", "n")])
    more = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "links": T.ArrayType(link)}
    names = {x: fresh(docs, x) for x in more}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[x], kind) for x, kind in more.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*both.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for p, q in lots([x or "" for x in texts]):
                found = aligner.documents(texts[p:q])
                edge = np.searchsorted(found.owner, np.arange(q - p + 1))
                a, b = (found.codes // aligner.b.size).tolist(), (found.codes % aligner.b.size).tolist()
                n = found.times.tolist()
                links = [[{"a": a[i], "b": b[i], "n": n[i]} for i in range(x, y)] for x, y in zip(edge, edge[1:], strict=False)]
                columns = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("a", "b", "n")]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(p, q - p).columns, *columns, pa.array(found.groups, pa.string()), pa.array(links, kind)], names=[*batch.schema.names, *names.values()]
                )

    return docs.mapInArrow(run, schema)


BLOCK = {
    "block": pa.int64(), "ids": pa.binary(), "shapes": pa.binary(), "digests": pa.binary(), "codes": pa.binary(), "held": pa.binary(), "many": pa.binary(),
    "refs": pa.binary(), "times": pa.binary(),
}
SENT = "part int, block long, codes binary, held binary"
ANSWER = "part int, block long, counts binary, best binary"
FOUND = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Block:
    """Documents gathered until they make a block."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, numbers: np.ndarray, found: Documents, size: int) -> None:
        digests = b"".join(hashlib.sha256(x.encode()).digest() for x in found.groups)
        shapes = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links], axis=1)
        many = np.bincount(found.owner, minlength=len(numbers))
        self.parts.append((numbers, shapes, digests, many, found.codes, found.times))
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        """The block: by document ids, shapes, digests and how many links; the distinct codes and how many documents hold each; links as differences of their places among the codes, and how often."""
        numbers, shapes, digests, many, codes, times = zip(*self.parts, strict=True)
        many, times = np.concatenate(many), np.concatenate(times)
        distinct, refs = np.unique(np.concatenate(codes), return_inverse=True)
        held = np.bincount(refs, minlength=len(distinct))
        step = np.diff(refs, prepend=0)
        begin = (np.cumsum(many) - many)[many > 0]
        step[begin] = refs[begin]
        values = [
            number, np.concatenate(numbers).astype("<i8").tobytes(), np.concatenate(shapes).astype("<i8").tobytes(), b"".join(digests), distinct.astype("<i8").tobytes(),
            held.astype("<u4").tobytes(), many.astype("<u4").tobytes(), step.astype("<u4").tobytes(), times.astype("<u4").tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, BLOCK.values(), strict=True)], names=list(BLOCK))


def part_of(codes: np.ndarray, width: int, parts: int) -> np.ndarray:
    """The partition of each code's A id."""
    return (mix((codes // width).astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def add_up(width: int):
    """For a partition's codes: documents that hold each, and whether no other code of its A id is held by more."""

    def run(table: pa.Table) -> pa.Table:
        codes, lengths = unpacked(table["codes"], np.int64)
        held = unpacked(table["held"], np.uint32)[0].astype(np.int64)
        distinct, place = np.unique(codes, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, held)
        a = distinct // width
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        highest = np.repeat(np.maximum.reduceat(total, first), np.diff(np.r_[first, len(a)])) if len(a) else total
        best = (total == highest).astype(np.uint8)
        edge = np.r_[0, np.cumsum(lengths)]
        rows = [place[p:q] for p, q in zip(edge, edge[1:], strict=False)]
        return pa.table({
            "part": table["part"].cast(pa.int32()), "block": table["block"].cast(pa.int64()),
            "counts": pa.array([total[x].astype("<i8").tobytes() for x in rows], pa.binary()), "best": pa.array([best[x].tobytes() for x in rows], pa.binary()),
        })

    return run


def settle(width: int, parts: int):
    """The documents of a block, with the answers to its codes."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = {x: [] for x in ("id", *FOUND, "digest")}
        for row in blocks.to_pylist():
            codes = np.frombuffer(row["codes"], "<i8")
            part = part_of(codes, width, parts)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            counts, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            for p, c, b in zip(answers["part"].to_pylist(), answers["counts"].to_pylist(), answers["best"].to_pylist(), strict=True):
                counts[order[edge[p] : edge[p + 1]]] = np.frombuffer(c, "<i8")
                best[order[edge[p] : edge[p + 1]]] = np.frombuffer(b, np.uint8)
            many, times = np.frombuffer(row["many"], "<u4").astype(np.int64), np.frombuffer(row["times"], "<u4").astype(np.int64)
            step = np.frombuffer(row["refs"], "<u4").astype(np.int64)
            doc = np.repeat(np.arange(len(many)), many)
            run_ = np.cumsum(step)
            begin = np.cumsum(many) - many
            refs = run_ - np.repeat(np.r_[0, run_][begin], many)  # places count anew in each document
            number = np.frombuffer(row["ids"], "<i8")
            shape = np.frombuffer(row["shapes"], "<i8").reshape(-1, 4)
            n_best, count_sum = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
            np.add.at(n_best, doc, best[refs] * times)
            np.add.at(count_sum, doc, counts[refs] * times)
            out["id"] += [None if x == NO_ID else x for x in number.tolist()]
            for i, x in enumerate(FOUND[:4]):
                out[x] += shape[:, i].tolist()
            out["n_best"] += n_best.tolist()
            out["count_sum"] += count_sum.tolist()
            out["digest"] += [row["digests"][32 * i : 32 * i + 32].hex() if shape[i, 0] else "" for i in range(len(many))]
        kinds = {"digest": pa.string()}
        return pa.table({x: pa.array(v, kinds.get(x, pa.int64())) for x, v in out.items()})

    return run


def agreement(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups' digest of each document.

    A link's count is how many documents hold its ids linked; count_sum adds them up over the document's links, and n_best
    counts the links whose count is the highest of their A id.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    both = sides(docs, path_a, path_b)
    width = both.value[1].size

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, number = Aligner(*both.value), Block(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            texts, numbers = batch.column(1).to_pylist(), ids(batch.column(0))
            for p, q in lots([x or "" for x in texts]):
                block.add(numbers[p:q], aligner.documents(texts[p:q]), sum(len(x or "") for x in texts[p:q]))
                if block.size >= BLOCK_BYTES:
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.parts:
            yield block.row(number)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, held = np.frombuffer(row["codes"], "<i8"), np.frombuffer(row["held"], "<u4")
                sent = packed(part_of(codes, width, parts), codes=codes, held=held)
                n = len(sent["shard"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent["shard"], pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(sent["codes"], pa.binary()), pa.array(sent["held"], pa.binary())],
                    names=["part", "block", "codes", "held"],
                )

    schema = T.StructType([T.StructField(x, T.LongType() if x == "block" else T.BinaryType()) for x in BLOCK])
    path = scratch(spark, "alignment")
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    plain.mapInArrow(gather, schema).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    answers = blocks.select("block", "codes", "held").mapInArrow(send, SENT).groupBy("part").applyInArrow(add_up(width), ANSWER)
    held = blocks.drop("held").groupBy("block").cogroup(answers.groupBy("block"))
    return held.applyInArrow(settle(width, parts), f"id long, {', '.join(f'{x} long' for x in FOUND)}, digest string")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return agreement(docs, default_path(), pieces_path()).withColumnsRenamed({"id": "doc_id", "digest": "groups_sha256"})
