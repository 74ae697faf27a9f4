"""Token counts against the tokenizers library."""

import unicodedata

import duckdb
import pytest
import regex
from tokenizers import Tokenizer

from catadrift.llm import counts, queries, tokens

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id int, n_tokens string"
ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "  \n\n \t x  ", "don't we'll 'S 's", "é" * 300, "\x00\x1c\x85 ", "日本語 ١٢٣ 🙂🙂", "x" * 20_000, "՘\U00010940 a"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(tokens.default_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def counter():
    bpe = tokens.Bpe(tokens.default_path())
    return counts.Counter(bpe, counts.whole_tokens(bpe))


def test_whole_tokens_are_one_token_in_the_library(counter, library):
    names = list(counter.whole)
    assert len(names) > 40_000 and "<|endoftext|>" not in names
    assert [e.ids for e in library.encode_batch(names, add_special_tokens=False)] == [[library.token_to_id(e)] for e in map(spelled, names)]
    found = {library.token_to_id(spelled(n)) for n in names}
    for i in set(range(len(counter.bpe.bytes))) - found:  # nothing that is one word and one token is missing
        body = counter.bpe.bytes[i].decode("utf-8", "replace")
        assert "�" in body or i in counter.bpe.special.values() or len(library.encode(body, add_special_tokens=False).ids) > 1 or len(counter.bpe.words.findall(body)) > 1


SIGNS = {b: c for c, b in tokens.byte_names().items()}


def spelled(name):
    return "".join(SIGNS[b] for b in name.encode())


def test_words_are_cut_as_in_the_library(counter):
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    signs = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"] + regex.findall(r".", "՘\U00010940꟎𐄇𝟘\U000105c0")
    for c in signs:
        text = f"a{c}b1{c}{c}! {c} {c}{c}x"
        assert counter.bpe.words.findall(text) == [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)], hex(ord(c))


def test_counts_equal_the_library(counter, library, monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    texts = [*ODD, "", "plain words only", *ODD]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for t in texts for n in counter.count([t])] == counter.count(texts)


def test_query(spark, library):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall()
    want = set()
    for doc, text in rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.add((doc, len(text.encode()), n, n > 512))
    got = queries.queries()["op11_token_counts"](spark, SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == want


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "x y"), *enumerate(ODD, 10)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    got = counts.token_counts(docs, tokens.default_path()).collect()
    want = [(i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert counts.token_counts(docs.limit(0), tokens.default_path()).count() == 0
    assert [r.over_limit for r in counts.over_limit(counts.token_counts(docs.where("doc_id = 2 AND text <> ''"), tokens.default_path()), 1).collect()] == [True, True]
