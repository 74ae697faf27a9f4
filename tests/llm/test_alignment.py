"""Tokenizer alignment against both libraries and brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catadrift.llm import alignment, queries, tokens
from catadrift.llm.alignment import Aligner, Pieces

SMALL = "/root/testdata/sf0.001"
ODD = [
    "<|endoftext|>", "<s> </s><unk> <0x41>", "  two  spaces ", " ", "   ", "a", "line\n\nline \t x", "don't we'll", "é" * 300, "日本語のテキスト 🙂", "x" * 5_000,
    "under▁score", "nul\x00nul", "½ ﬁ Å é", "   wide", "ends with space ", "\ttab first", "123 456,789.00", "a  b   c    d",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    a.no_truncation()
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.pieces_path())


@pytest.fixture(scope="module")
def aligner():
    with open(alignment.pieces_path(), "rb") as f:
        return Aligner(tokens.Bpe(tokens.default_path()), Pieces(f.read()))


def brute(libraries, text):
    """ids of both sides, groups as text, links with repeats."""
    if not text:
        return [], [], "", Counter()
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    names = tokens.byte_names()
    bytes_a = [bytes(names[c] for c in libraries[0].id_to_token(i)) for i in a]
    bytes_b = [bytes([int(libraries[1].id_to_piece(i)[3:5], 16)]) if libraries[1].is_byte(i) else libraries[1].id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], "", Counter()
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    shown, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        shown.append(",".join(map(str, a[at_a:p])) + "|" + ",".join(map(str, b[at_b:q])))
        at_a, at_b = p, q
    links = Counter()
    for i, end in enumerate(ends_a.tolist()):
        begin = end - len(bytes_a[i])
        for j in range(int(np.searchsorted(ends_b, begin, side="right")), len(b)):
            if ends_b[j] - len(bytes_b[j]) >= end:
                break
            links[a[i], b[j]] += 1
    return a, b, ";".join(shown), links


def whole(libraries, rows):
    """What the query returns, without the id."""
    found = [brute(libraries, t) for t in rows]
    held = Counter(pair for _, _, _, links in found for pair in links)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (
            len(a), len(b), shown.count(";") + 1 if shown else 0, sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else "",
        )
        for a, b, shown, links in found
    ]


def check(libraries, aligner, texts):
    got = aligner.documents(texts)
    for i, text in enumerate(texts):
        a, b, shown, links = brute(libraries, text)
        assert (got.n_a[i], got.n_b[i], got.groups[i]) == (len(a), len(b), shown), text
        mine = got.owner == i
        pairs = zip((got.codes[mine] // aligner.b.size).tolist(), (got.codes[mine] % aligner.b.size).tolist(), strict=True)
        assert dict(zip(pairs, got.times[mine].tolist(), strict=True)) == dict(links), text
        assert (got.n_groups[i], got.n_links[i]) == (shown.count(";") + 1 if shown else 0, sum(links.values()))


def test_windows_equal_brute_force(libraries, aligner, monkeypatch):
    check(libraries, aligner, [*ODD, None, "", *ODD])
    r = np.random.default_rng(0)
    signs = list("ab ,.'<>\n\t▁0é") + ["  ", "the ", " ing", "日", "🙂", " ", "un", "token"]
    check(libraries, aligner, ["".join(r.choice(signs, size=r.integers(1, 60))) for _ in range(400)])
    monkeypatch.setattr(alignment, "PIECE_CHARS", 10)
    monkeypatch.setattr(alignment, "WINDOWS", 3)
    check(libraries, aligner, ODD)
    check(libraries, aligner, ["".join(r.choice(signs, size=r.integers(1, 60))) for _ in range(50)])


def test_texts_without_tokens(libraries, aligner):
    got = aligner.documents([None, "", "under▁score", "fine"])
    assert got.n_a.tolist()[:3] == [0, 0, 0] and got.groups[:3] == ["", "", ""] and got.n_a[3] > 0 and set(got.owner) == {3}
    assert aligner.documents([None, ""]).groups == ["", ""] and aligner.documents([]).groups == []


def test_query(spark, libraries):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall()
    want = {(doc, *x) for (doc, _), x in zip(rows, whole(libraries, [t for _, t in rows]), strict=True)}
    df = queries.queries()["op12_tokenizer_alignment"](spark, SMALL)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in df.collect()} == want


def test_edges(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50)
    rows = [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "x y"), *enumerate(ODD, 10)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, groups string, n_a int")
    got = alignment.agreement(docs, tokens.default_path(), alignment.pieces_path())
    want = [((i or 0), *x) for (i, _), x in zip(rows, whole(libraries, [t for _, t in rows]), strict=True)]
    assert sorted((r.id or 0, *tuple(r)[1:]) for r in got.collect()) == sorted(want)
    assert alignment.agreement(docs.limit(0), tokens.default_path(), alignment.pieces_path()).count() == 0
    out = alignment.align(docs, tokens.default_path(), alignment.pieces_path())
    assert out.columns[:5] == docs.columns and out.columns[5:] == ["n_a_", "n_b", "n_groups", "n_links", "groups_", "links"]
    for r in out.collect():
        a, _, shown, links = brute(libraries, r.text)
        assert (r.n_a_, r.groups_) == (len(a), shown) and {(x.a, x.b): x.n for x in r.links} == dict(links)
